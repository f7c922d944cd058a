"""Siltstone: heterogeneous-file analytics expressed as Spark plans."""
