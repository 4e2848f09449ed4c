"""semindex: Spark jobs that chunk text corpora, index them as vectors and search them."""
