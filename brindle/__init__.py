"""brindle: hybrid retrieval, query-log analytics and corpus preparation on Spark DataFrames."""
