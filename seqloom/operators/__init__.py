"""Relational and array operators over sequence, alignment and structure tables."""
