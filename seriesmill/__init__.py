"""seriesmill: data series read from figures, as Spark plans.

functions/  scalar and array expressions     operators/  plans over DataFrames
sources/    readers and writers               plans/      queries over the driver tables and their SQL
streaming/  structured-streaming forms        llm/        operators for training text and samples (optional)
"""
