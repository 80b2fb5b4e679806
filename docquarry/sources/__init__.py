"""Readers and writers: files, chunk table, registry tables."""
