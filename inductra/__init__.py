"""Staff-induction analytics expressed as Spark DataFrame and streaming jobs."""
