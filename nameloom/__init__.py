"""Entity resolution, retrieval and training-data preparation on PySpark."""
