"""glotweave: corpus cleaning and cross-lingual word-vector analytics as PySpark DataFrame operators."""
