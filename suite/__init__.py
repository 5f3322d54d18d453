"""The registered queries: every operator over market tables derived from the given tables."""
