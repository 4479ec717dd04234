"""Row-ordered table queries and training-data operators on PySpark."""
