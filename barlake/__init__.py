"""barlake: price-bar analytics and corpus preparation expressed as Spark plans."""
