"""Writers of clusterings, lists, ratings and report tables."""
