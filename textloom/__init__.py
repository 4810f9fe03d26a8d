"""textloom: a PySpark-native engine for text-corpus analytics.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Catalyst expressions; Arrow batches are used only where Spark has no built-in
equivalent.  Lexicons, thresholds and node terms are parameters.
"""

__version__ = "0.1.0"
