"""Spark-first graph analytics: tables of vertices and edges in, tables out."""
