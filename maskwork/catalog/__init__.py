"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import importlib

from maskwork.catalog.base import Catalog

MODULES = ("detect", "redact", "chat", "traffic", "wire", "streams")


def build() -> Catalog:
    catalog = Catalog()
    for name in MODULES:
        importlib.import_module(f"maskwork.catalog.{name}").register(catalog)
    return catalog
