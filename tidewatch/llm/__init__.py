"""Training-data operators: ten corpus-scale jobs and their registered queries.

Nothing outside this subpackage imports it; it can be removed whole.
"""
