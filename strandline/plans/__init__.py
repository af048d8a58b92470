"""Topologies and the query catalogue."""
