"""doclathe: document analytics written as PySpark DataFrame programs."""
