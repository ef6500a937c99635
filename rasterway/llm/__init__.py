"""Operators for training-data pipelines over the documents and pages tables.

Nothing else in the library imports this subpackage.  Every operator is a
function on DataFrames; ``queries`` registers one thin query per operator.
"""
