"""Change-set, partition and dependency-graph analytics as Spark DataFrame operators."""
