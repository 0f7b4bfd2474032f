"""Composed queries over the driver's tables, each with the SQL that states the same result."""

import importlib

MODULES = ("records_queries", "geometry_queries", "telemetry_queries", "packets_queries", "config_queries",
           "storage_queries")


def load_catalog():
    """Import every query module once and return the registry."""
    for name in MODULES:
        importlib.import_module(f"beamfold.plans.{name}")
    return importlib.import_module("beamfold.plans.catalog")
