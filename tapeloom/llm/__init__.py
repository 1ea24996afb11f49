"""Operators for preparing language-model training corpora with Spark.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only while the package is present.
"""
