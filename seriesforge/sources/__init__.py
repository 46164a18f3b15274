"""Readers and writers of series, dataset lists and result tables."""
