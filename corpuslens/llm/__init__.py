"""Training-data operators: cleaning, scoring, extraction, packing and deduplication.

Every operator is a function from DataFrames to a DataFrame; ``queries`` binds them to the test
tables. Nothing else in the library imports this subpackage.
"""
