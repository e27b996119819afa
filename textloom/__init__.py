"""textloom: document analytics on PySpark, DataFrame in and DataFrame out."""
