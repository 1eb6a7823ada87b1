"""Operators of a training-data pipeline: near-duplicate joins, extraction,
decontamination, classifiers, sharding, packing.  Nothing outside this
subpackage imports it."""
