"""Media-catalogue and training-data analytics as Spark DataFrame operators."""
