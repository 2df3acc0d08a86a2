"""The queries of this subpackage and the SQL that they are compared with."""

from __future__ import annotations

from . import decontaminate, linededup, merkle, neighbours, packing, periodic, pii, quality, secrets, shards, simhash, toxicity, warc

MODULES = (linededup, shards, pii, warc, toxicity, quality, secrets, packing, simhash, decontaminate, periodic, merkle, neighbours)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
