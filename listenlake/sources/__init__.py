"""Landed files, lake tables and the mapping of the test tables to the domain."""
