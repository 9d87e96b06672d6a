"""graftwork: point-cloud and weighted-graph analytics as PySpark DataFrame plans."""
