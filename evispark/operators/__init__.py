"""DataFrame -> DataFrame operators; no actions inside."""
