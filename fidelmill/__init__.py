"""Corpus-quality and text-correction analytics on PySpark."""
