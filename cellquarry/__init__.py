"""A Spark-first engine for evidence-grounded analytics over report tables."""
