"""millrace: byte-chunk dataflow pipelines and relational analytics as Spark jobs."""
