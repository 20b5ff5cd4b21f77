"""Readers: files, records, Markdown, source code, diffs and media as rows of items."""
