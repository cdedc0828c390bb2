"""Build-graph and compilation-artifact analytics on Spark."""
