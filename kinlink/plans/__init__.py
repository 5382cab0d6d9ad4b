"""Composed plans: normalisation, linkage end to end."""
