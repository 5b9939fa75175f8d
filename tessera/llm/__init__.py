"""Training-data operators: cleaning, scoring, de-duplication, packing, formatting.

Nothing outside this subpackage imports it. Every module holds one operator
with a general interface; ``queries.py`` binds the operators to the driver
tables.
"""
