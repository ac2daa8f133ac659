"""Field validation and detector evaluation on Spark DataFrames."""
