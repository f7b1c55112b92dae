"""catloom: stored web pages in, clean de-duplicated catalog out, on plain PySpark.

Every operator takes and returns DataFrames or Columns, so the same code runs in
batch, inside ``foreachBatch`` and in SQL through :mod:`catloom.functions.registry`.
"""
