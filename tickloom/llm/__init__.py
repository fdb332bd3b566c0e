"""Training-data operators: each one a Spark job over whole tables.

Nothing outside this subpackage imports it.
"""
