"""The queries of this package, by name, and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("language_id", "license_scan", "chat_format", "exact_dedup", "near_dedup", "media", "mixing", "quality", "bpe", "substring_dedup", "merkle", "packing", "collocations")


def _all(kind: str) -> dict:
    out = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
