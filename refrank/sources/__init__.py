"""refrank.sources."""
