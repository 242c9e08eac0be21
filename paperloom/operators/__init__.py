"""Relational operators from page records to validated documents."""
