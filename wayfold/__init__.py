"""wayfold: spatial-graph analytics as DataFrame operators on Spark."""
