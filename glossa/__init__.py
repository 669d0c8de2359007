"""Span analytics on Spark: abbreviation-definition extraction as DataFrame plans."""
