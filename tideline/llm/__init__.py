"""Training-data operators: sharding, packing, joins, filters, mixing and labelling of text corpora."""
