"""City-scale building analytics as Spark DataFrame plans."""
