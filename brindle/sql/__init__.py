"""The SQL dialect: parsing, binding to DataFrames, sessions with transactions and locks."""
