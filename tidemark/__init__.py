"""tidemark: versioned text memory, retrieval and evaluation as Spark jobs."""
