"""Training-data operators: classifiers, fingerprints, joins, indexes, filters and a tokenizer.

Nothing outside this subpackage imports it; ``registry`` holds the registered queries and their SQL.
"""
