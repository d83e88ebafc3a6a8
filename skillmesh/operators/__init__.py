"""Relational operators: profile, recommendation, lookups, rollups, titles."""
