"""Readers and writers for pixel tables and result tables."""
