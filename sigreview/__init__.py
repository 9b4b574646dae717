"""Explained, reviewable signals from measurement feeds, as Spark DataFrame operators."""
