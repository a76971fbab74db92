"""Training-data operators: each module is one operator; ``queries`` registers one query for each.

Nothing else in the library imports this subpackage.
"""
