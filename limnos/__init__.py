"""limnos: Spark-native operators for environmental measurement tables.

Every operator is a function ``DataFrame -> DataFrame`` (or a one-row
statistics frame) with column names as parameters.  Work that grows with
the number of rows runs as Spark SQL / Spark ML jobs; only one-row
statistics and model metadata reach the driver.
"""

__all__ = ["session"]
