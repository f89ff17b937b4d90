"""Relational operators: de-duplication, clustering, quality rules, health, snapshot changes."""
