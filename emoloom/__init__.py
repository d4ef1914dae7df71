"""A Spark-first engine for building and evaluating labelled comment corpora."""
