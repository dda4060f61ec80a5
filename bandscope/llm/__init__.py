"""Training-data pipeline operators.

Nothing outside this subpackage imports it; ``registry`` holds the queries
that ``__spark_entry__`` adds when the subpackage is present.
"""
