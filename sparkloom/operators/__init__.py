"""Operators over tables: the action stack, drill-down and navigation."""
