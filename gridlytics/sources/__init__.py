"""Reading, writing and merging tables."""
