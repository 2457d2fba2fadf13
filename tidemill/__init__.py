"""Tidemill: curation and evaluation of training data as Spark DataFrame plans."""
