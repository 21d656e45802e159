"""Training-data operators.

Nothing else in the library imports this subpackage.  Operators take and return
DataFrames; :mod:`tideline.llm.entry` registers one query per operator.
"""
