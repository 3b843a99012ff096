"""Readers, writers and result names."""
