"""Readers: stored payloads, pages, search hits, sitemaps, feeds, logs and dimensions."""
