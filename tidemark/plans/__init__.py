"""Whole plans made of operators: the row-local scorer, and audits of plans."""
