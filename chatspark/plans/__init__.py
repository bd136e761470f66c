"""Named queries and their oracles."""
