"""millrace: an analytics engine made of Spark DataFrame and SQL plans."""
