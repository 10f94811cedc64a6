"""barloom: price-and-volume panel analytics as plain Spark DataFrame plans."""
