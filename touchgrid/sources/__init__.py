"""Readers and writers of match tables."""
