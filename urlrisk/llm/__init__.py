"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
column names, reads only the columns it is given (extra columns are ignored) and
returns a DataFrame.
"""
