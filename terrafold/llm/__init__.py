"""Training-data operators: tokenising, scoring, de-duplication, decontamination.

Nothing else in the package imports this one.
"""
