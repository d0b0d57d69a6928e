"""A single-table query dialect: definitions, changes and selects, over DataFrames."""
