"""Flows, registered queries and their SQL twins."""
