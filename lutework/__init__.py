"""Notation analytics on Spark: DataFrame-first operators over scores, plans and corpora."""
