"""helix: sequencing analytics as Spark DataFrames."""
