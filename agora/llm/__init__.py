"""Operators of a training-data pipeline over documents, pages and vectors.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames, keeps the columns
it does not own, and writes what must outlive a stage to the folder named by ``spark.checkpoint.dir``.
"""
