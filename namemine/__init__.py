"""namemine: mine names and naming context from large corpora with Spark.

Every operator is a DataFrame -> DataFrame function built from Spark SQL
primitives (windows, joins, aggregations, higher-order array functions).
"""

__version__ = "0.1.0"
