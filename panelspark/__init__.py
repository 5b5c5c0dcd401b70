"""Market and other (entity, time) panels on PySpark: DataFrame in, DataFrame out."""
