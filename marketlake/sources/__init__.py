"""Readers: composition and series files, landed responses, event lists, stored tables."""
