"""quern: a PySpark-native analytics engine over code collections.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
on the driver except values whose size is bounded by a parameter.
"""

__version__ = "0.1.0"
