"""Column-level functions: map algebra, text-to-number and date helpers."""
