"""Place suitability, listing resolution and training-data operators on PySpark."""
