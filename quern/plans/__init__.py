"""From documents to DataFrames: schema, normalising, packing, compiling."""
