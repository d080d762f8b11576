"""Leafmill sources."""
