"""Operators for preparing language-model training data.

One module for each operator; ``queries`` registers them over the driver's tables.
"""
