"""Leafmill operators."""
