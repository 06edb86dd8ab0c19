"""Listing intelligence as Spark DataFrame jobs."""
