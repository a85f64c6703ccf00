"""Hybrid document retrieval as DataFrame transformations."""
