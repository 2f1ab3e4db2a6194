"""Reconciliation of two keyed polygon datasets as Spark plans, and the data products around it."""
