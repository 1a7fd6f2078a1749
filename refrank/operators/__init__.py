"""refrank.operators."""
