"""Bitemporal fact store and hybrid retrieval, expressed as Spark plans."""
