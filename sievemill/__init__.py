"""sievemill: retrieval, ranking and corpus analytics written as Spark plans."""
