"""Relational operators, one module per subject."""
