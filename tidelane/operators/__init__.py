"""Batch operators: columns and DataFrame transformations of the event model."""
