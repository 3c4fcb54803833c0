"""DataFrame operators over pixel tables."""
