"""Query catalogue: one module per family, all registered on import."""

from chromloom.catalog import registry


def load() -> None:
    import importlib

    for module in (
        "curves", "contacts", "maps", "loops", "dynamics", "sites", "io", "checks", "stats",
        "summary", "runs", "text", "reports",
    ):
        importlib.import_module(f"chromloom.catalog.q_{module}")


__all__ = ["load", "registry"]
