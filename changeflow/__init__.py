"""changeflow: data integration and change-data capture on Spark DataFrames."""
