"""Operators for preparing text at corpus scale: rules, mixing, packing, deduplication, sharding, filters, language."""
