"""Knowledge-graph memory analytics expressed as Spark DataFrame plans."""
