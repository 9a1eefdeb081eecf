"""Corpus operators for large training sets (deduplication, filtering, packing, archives)."""
