"""Scan-metrology analytics on Spark DataFrames.

Every operator is keyed (cloud, session, frame, station) and handles all groups of a
fleet in one job; a group is never assumed to fit into one task.
"""

__version__ = "0.1.0"
