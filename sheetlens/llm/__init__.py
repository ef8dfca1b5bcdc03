"""Operators for training-data pipelines: near-duplicate detection, quality,
packing, vector search, repeated-passage removal, language identification,
mixing, page extraction and sharding.  Nothing else in the library imports
this subpackage."""
