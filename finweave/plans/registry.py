"""Where plans register their queries and DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from finweave.functions.num import NUDGE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def nudged(sql: str) -> str:
    """The statement with every round(x, n) as round((x) * NUDGE, n)."""
    out, at = [], 0
    while (k := sql.find("round(", at)) >= 0:
        depth, i, comma = 1, k + 6, -1
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        out.append(sql[at:k])
        if comma < 0:
            out.append("round(" + nudged(sql[k + 6 : i - 1]) + ")")
        else:
            out.append(f"round(({nudged(sql[k + 6 : comma])}) * {NUDGE}, {sql[comma + 1 : i - 1].strip()})")
        at = i
    return "".join([*out, sql[at:]])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = nudged(sql)
        return f

    return add
