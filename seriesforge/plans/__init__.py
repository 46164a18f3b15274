"""Registered queries and experiment drivers."""
