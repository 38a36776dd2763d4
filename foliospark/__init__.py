"""Structured-document analytics on Spark: parse, structure, enrich, index, retrieve and answer as DataFrame plans."""
