"""operators of the reconciliation engine."""
