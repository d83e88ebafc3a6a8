"""Column builders: tokenisers, predicates, title cleaning, share arithmetic."""
