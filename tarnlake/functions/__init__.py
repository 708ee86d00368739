"""Typed expressions: nodes, their meaning as Columns, and the prefix notation of the operator API."""
