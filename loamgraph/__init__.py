"""A PySpark-native engine for code-history graphs and the tables around them.

Everything is expressed as DataFrame plans. Python runs only where a text must be
scanned character by character or where a driver loop decides when to stop.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
