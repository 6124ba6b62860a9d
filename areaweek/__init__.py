"""Weekly area surveillance and forecasting on Spark DataFrames.

Layers, each importing only from those above it:

``config``     rates, cut-offs, forest sizes and the fixed area tables
``schemas``    the StructType of every persisted relation
``functions``  Column expressions (no I/O, no actions)
``sources``    files, payloads, report grids, listing pages -> tidy rows
``operators``  DataFrame -> DataFrame building blocks
``plans``      the composite jobs
``checks``     the jobs applied to the shared test tables, with SQL twins
"""

__version__ = "0.1.0"
