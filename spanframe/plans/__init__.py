"""Named queries over the test tables, each with its SQL counterpart."""

from importlib import import_module

CORE_MODULES = ("rejects", "spans", "curation", "tokens", "runs", "general", "wordpiece", "checks", "files")


def load(modules: tuple[str, ...]) -> None:
    """Import the query modules, which register their queries."""
    for name in modules:
        import_module(f"{__name__}.{name}")
