"""refrank.functions."""
