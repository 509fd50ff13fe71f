"""Operators for training-data pipelines.

Nothing else in the library imports this package. Each operator is a module with
its own interface; ``queries`` registers one query per operator.
"""
