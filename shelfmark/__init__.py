"""shelfmark: knowledge-base retrieval and evaluation as Spark jobs."""
