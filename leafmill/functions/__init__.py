"""Leafmill functions."""
