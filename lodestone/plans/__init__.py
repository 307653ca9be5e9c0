"""Registered queries and the services composed from operators."""
