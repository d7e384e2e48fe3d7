"""Compositions: the trends engine, searches, company pages."""
