"""Reports built from period sums."""
