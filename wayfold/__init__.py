"""Wayfold: groups of objects that move together, found with DataFrames; and operators for training-data tables."""
