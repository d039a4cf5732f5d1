"""Incremental ingestion (an extension: the studied system has no streams)."""
