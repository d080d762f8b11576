"""Leafmill plans."""
