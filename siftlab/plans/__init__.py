"""Registered queries over the given tables."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every plan module so that its queries register themselves."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_plans"):
            importlib.import_module(f"{__name__}.{module.name}")
