"""Leafmill: document, page and report processing as Spark DataFrame plans."""
