"""Deductive validation analytics and training-data operators on PySpark DataFrames."""
