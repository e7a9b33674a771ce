"""Registered queries: Spark plan plus reference SQL."""
