"""Corpus analytics on Spark: building, cleaning, auditing and comparing parallel text corpora."""
