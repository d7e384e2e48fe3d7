"""The query registry: one name, one Spark callable, at most one oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import BINDINGS, Bindings, oracle_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register `fn(bindings) -> DataFrame`; bindings the oracle text names become its CTEs."""

    def register(fn: Callable[[Bindings], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Bindings(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = bind_oracle(oracle)
        return fn

    return register


def bind_oracle(text: str) -> str:
    used = [n for n in BINDINGS if re.search(rf"\b(?:FROM|JOIN|IN|USING)\s+\(?{n}\b|,\s*{n}\s", text)]
    body = text.strip()
    if not used:
        return body
    ctes = oracle_ctes(tuple(used))
    if re.match(r"WITH\s", body, re.I):
        head = "WITH RECURSIVE" if re.match(r"WITH\s+RECURSIVE\s", body, re.I) else "WITH"
        rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
        return f"{head} {ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"
