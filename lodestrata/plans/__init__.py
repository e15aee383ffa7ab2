"""Named queries: each module has QUERIES (name -> (callable, SQL or None))."""
