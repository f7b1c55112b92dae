"""Whole jobs, composed from the operators: list pages, detail pages, the category tree."""
