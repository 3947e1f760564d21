"""Registered queries with their SQL oracles, over views of the test tables."""
