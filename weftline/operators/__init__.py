"""The relational operators of scripts, over DataFrames."""
