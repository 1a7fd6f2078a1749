"""refrank.streaming."""
