"""occgraph: spatial-occurrence analytics expressed as Spark DataFrame jobs."""
