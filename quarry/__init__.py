"""quarry: catalog building, ranked retrieval and corpus preparation as Spark DataFrame programs."""
