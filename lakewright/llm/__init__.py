"""Training-data operators: cleaning, scoring, search, tokenising, archiving and packing of text.

Nothing else in the package imports this subpackage.
"""
