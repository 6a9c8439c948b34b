"""Temporal knowledge retrieval, work coordination and corpus analytics on Spark."""
