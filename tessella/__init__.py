"""tessella: catalog, preference and corpus analytics written as Spark DataFrame jobs."""
