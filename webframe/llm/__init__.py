"""Operators of a training-data pipeline over tables of documents and pages.

Each module holds one operator with an interface of its own; `queries` applies them to whole tables.
Nothing else in the library imports this package."""
