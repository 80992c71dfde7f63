"""Verified record analytics on Spark: records in, exact cited answers out."""
