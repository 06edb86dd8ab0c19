"""Compositions: the scan job and the serving job."""
