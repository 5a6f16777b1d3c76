"""daygrid: cohort tables and day-indexed series as Spark DataFrames."""
