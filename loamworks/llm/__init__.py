"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrame to DataFrame that names the columns it reads, so further columns of
its input, whatever their names, do no harm.
"""
