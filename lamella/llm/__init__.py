"""Operators for preparing language-model training text on Spark.

Each module holds one operator with a general interface; ``queries`` derives the registered queries from them.
"""
