"""Filters, period sums and joins of the fact table."""
