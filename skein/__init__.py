"""skein: document analytics on Spark DataFrames.

Sub-packages: ``functions`` (Column expressions), ``sources`` (readers),
``operators`` (relational document operators), ``plans`` (composed queries and
run-time helpers) and ``streaming`` (Structured Streaming forms).
"""

__version__ = "0.1.0"
