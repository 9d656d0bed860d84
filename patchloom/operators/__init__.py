"""Relational operators: parsing, matching, folding, scoring and routing."""
