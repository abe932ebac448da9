"""Whole queries: detection, rescans and searches."""
