"""Plan helpers: lineage cuts, size-checked broadcasts, table access."""
