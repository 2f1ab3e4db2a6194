"""plans of the reconciliation engine."""
