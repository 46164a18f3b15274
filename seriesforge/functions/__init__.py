"""Kernel banks and column functions."""
