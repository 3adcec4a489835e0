"""Named queries over the driver's tables."""

from importlib import import_module

MODULES = ["scans", "relations", "graphs", "texts", "writes", "streams"]


def load():
    """(queries, oracle SQL) of all modules."""
    for name in MODULES:
        import_module(f"mnemograph.catalog.{name}")
    from mnemograph.catalog.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
