"""Cost-estimate tables at scale: DataFrame operators on Spark."""
