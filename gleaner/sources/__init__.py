"""Readers, writers and request plans."""
