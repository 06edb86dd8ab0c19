"""Payload tables, extraction jobs and state snapshots."""
