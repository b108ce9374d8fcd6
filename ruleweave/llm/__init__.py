"""Training-data operators: ten distributed text operators and their registered queries.

Nothing outside this subpackage imports it.
"""
