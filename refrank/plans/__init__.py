"""refrank.plans."""
