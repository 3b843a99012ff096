"""Composites: report tables built from the operators."""
