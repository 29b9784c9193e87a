"""isoframe: image-container analytics as Spark DataFrames."""
