"""Session-history analytics on Spark: transcripts to tables, ranked search, recaps, statistics."""
