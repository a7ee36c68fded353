"""Relational operators on inspected frames."""
