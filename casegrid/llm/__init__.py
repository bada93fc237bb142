"""Operators of a training-data pipeline: each module holds one operator with its
own interface; ``registry`` holds the registered queries and their SQL."""
