"""Operators for training-data pipelines over the tables of documents.

Every operator takes DataFrames and returns DataFrames. ``suite.py`` registers one query for each.
Common to all: columns are read by name and cast, further columns are ignored (or passed through
where rows are filtered); a null text counts as an empty one; no table may be missing, but any may
be empty.
"""
