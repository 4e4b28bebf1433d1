"""Inputs: pages, schemas, configuration, fixtures."""
