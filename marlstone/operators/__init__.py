"""Operators on tables of series, samples and postings."""
