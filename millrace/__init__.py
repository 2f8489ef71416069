"""millrace: analytics, retrieval and corpus operators as Spark DataFrame programs."""
