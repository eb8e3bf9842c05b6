"""Queries over the driver's tables: thin uses of the operators, each beside its SQL."""
