"""Readers and writers of tables, pages, feeds and media containers."""
