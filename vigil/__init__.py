"""Fleet health analytics as Spark DataFrame transformations."""
