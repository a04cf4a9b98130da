"""Semantic-record analytics on Spark."""
