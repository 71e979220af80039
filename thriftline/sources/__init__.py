"""Readers: archives, source trees, result documents and requirement files."""
