"""Interval analytics on Spark: counting, clustering, statistics and annotation of genomic intervals."""
