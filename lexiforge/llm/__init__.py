"""Training-data operators: filters, extraction, mixing, packing and archives over Spark DataFrames."""
