"""Readers: board and people feeds, resume documents, scraped pages, manual rows."""
