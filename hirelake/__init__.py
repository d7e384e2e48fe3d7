"""Hiring-data analytics as Spark jobs: postings in, typed tables, rankings and trends out."""

__version__ = "0.1.0"
