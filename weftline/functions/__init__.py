"""The expression language of scripts: parsing, static types, and native Spark columns."""
