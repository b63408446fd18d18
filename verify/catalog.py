"""Imports every query module so that its queries register."""

from importlib import import_module

MODULES = ["spatial", "text", "splits", "eval", "models", "fits"]


def load() -> None:
    for name in MODULES:
        import_module(f"verify.q_{name}")
