"""Whole searches: each plan wires jobs from stored inputs to offers or documents."""
