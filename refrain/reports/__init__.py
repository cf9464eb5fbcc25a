"""Reports of clones and statistics in common formats."""
