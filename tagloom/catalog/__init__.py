"""All registered queries and the SQL each one is checked against."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

for _topic in ("labels", "metrics", "splits", "text", "features", "model", "sources"):
    _module = importlib.import_module(f"tagloom.catalog.{_topic}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
