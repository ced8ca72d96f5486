"""Planning helpers: session settings, lineage cuts, and joins whose broadcast side is checked."""
