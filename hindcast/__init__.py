"""Point-in-time predictive analytics over relational tables, as Spark DataFrame jobs."""
