"""Training-data operators: scoring, duplicate removal, filters, joins, tokenising, rendering, archives.

Nothing else in the library imports this subpackage.  ``registry`` lists its queries.
"""
