"""Relational operators: predicates, listing, mutations, lookups, validation, state."""
