"""Operators for training-data pipelines over document tables.

Each module holds one operator with a general interface and the thin query
``opN_<name>`` that applies it to its whole table; ``registry`` lists them.
Nothing outside this package imports it.
"""
