"""Relational operators over DataFrames, with predicates, keys and projections as expressions, prefix strings or Columns."""
