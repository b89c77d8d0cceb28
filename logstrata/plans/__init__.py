"""Composed jobs and the registered queries."""


def all_queries():
    from importlib import import_module
    from pkgutil import iter_modules

    from .registry import REGISTRY

    for module in iter_modules(__path__):
        if module.name.startswith("queries_"):
            import_module(f"{__name__}.{module.name}")
    return REGISTRY
