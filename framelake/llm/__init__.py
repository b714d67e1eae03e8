"""Training-data operators: packing, near-duplicate and repeat removal, chat rendering, classifiers,
secret scanning, language identification, vector search and benchmark decontamination.

Nothing outside this subpackage imports it.  ``registry`` holds the queries the repository entry point adds.
"""
