"""Named queries, each a builder (spark, sf_dir) -> DataFrame with an independent SQL statement."""
