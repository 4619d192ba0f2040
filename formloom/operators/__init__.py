"""Relational operators over the provenance tables."""
