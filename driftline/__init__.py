"""Change-history analytics and training-text preparation on PySpark."""
