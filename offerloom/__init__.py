"""Offer analytics as PySpark DataFrame jobs."""

from offerloom.session import build_session, tune

__all__ = ["build_session", "tune"]
