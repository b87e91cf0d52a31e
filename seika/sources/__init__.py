"""Inputs: CSV files, portal pages, encodings, and views over the test tables."""
