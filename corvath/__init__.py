"""corvath - document search, ranking and corpus preparation as Spark plans."""
