"""panelweave: expression-panel analytics as Spark DataFrame operators.

The fact table is long and sparse -- ``expr(cell_id, gene, value)``, a missing
row is a zero -- and ``cells(cell_id, celltype)`` supplies the row counts the
zeros need.  Every operator takes DataFrames and returns a DataFrame.
"""
