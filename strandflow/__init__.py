"""strandflow: typed record pipelines and corpus operators on PySpark."""
