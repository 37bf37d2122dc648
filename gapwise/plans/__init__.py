"""Whole workflows and the catalogue of registered queries."""
