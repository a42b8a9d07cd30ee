"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; it needs only ``pyspark`` and the Python packages that each module names.
"""
