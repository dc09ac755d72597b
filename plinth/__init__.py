"""Property-market analytics on Spark DataFrames.

Everything here takes and returns ``DataFrame`` / ``Column`` values; nothing runs a job unless its
docstring says so.
"""

__version__ = "0.1.0"
