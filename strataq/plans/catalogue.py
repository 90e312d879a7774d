"""Imports every module that registers queries."""

from __future__ import annotations

from strataq.plans import checks, composites, documents, ledgers, metrics, streams  # noqa: F401

FLAGSHIP = "fold_lifo_ledger"
