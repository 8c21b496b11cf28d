"""rollweave: record consolidation and data preparation on PySpark.

Every operator is a function DataFrame -> DataFrame; nothing is executed until the caller runs an action, except where a
docstring says that an operator writes intermediate results to the shared checkpoint folder.
"""

__version__ = "0.1.0"
