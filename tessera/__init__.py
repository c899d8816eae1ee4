"""tessera: image-compression analytics and corpus preparation on Spark DataFrames."""
