"""Gleaner: hybrid retrieval over note collections, written as Spark DataFrame plans."""
