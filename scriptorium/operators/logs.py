"""Append-only logs: events, costs, runs; and what they tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tail(runs: DataFrame, n: int, at: str = "at", key: str = "run_id") -> DataFrame:
    """The last ``n`` records, newest first, ties by key."""
    return runs.where(F.col(at).isNotNull()).orderBy(F.desc(at), F.desc(key)).limit(n)


def costs(log: DataFrame, every: str = "1 day", at: str = "at", op: str = "op", amount: str = "tokens") -> DataFrame:
    """(op, start, calls, total): calls and amounts of each operation by window; null times are left out."""
    rows = log.where(F.col(at).isNotNull()).groupBy(op, F.window(at, every).alias("w"))
    return rows.agg(F.count("*").alias("calls"), F.round(F.sum(amount), 4).alias("total")).select(op, F.col("w.start").alias("start"), "calls", "total")


def previous(log: DataFrame, key: str, at: str, kind: str) -> DataFrame:
    """Each record with the time and kind of the one before it under the same key."""
    from pyspark.sql import Window

    by = Window.partitionBy(key).orderBy(at, kind)
    return log.withColumns({"before": F.lag(at).over(by), "before_kind": F.lag(kind).over(by)})


def run_report(run: dict, lists: int = 10, warnings: int = 20) -> str:
    """A run record as markdown: values as bullets, lists cut to ``lists``, first warnings."""

    def bullets(value, depth: int = 0) -> list[str]:
        pad = "  " * depth
        out = []
        if isinstance(value, dict):
            for k, v in value.items():
                if isinstance(v, (dict, list)):
                    out += [f"{pad}- {k}:", *bullets(v, depth + 1)]
                else:
                    out.append(f"{pad}- {k}: {v}")
        else:
            out += [f"{pad}- {v}" for v in value[:lists]]
            if len(value) > lists:
                out.append(f"{pad}- and {len(value) - lists} more")
        return out

    body = {k: v for k, v in run.items() if k not in ("warnings", "command")}
    lines = [f"# Run: {run.get('command', '')}", "", *bullets(body)]
    if run.get("warnings"):
        lines += ["", "## Warnings", "", *[f"- {w}" for w in run["warnings"][:warnings]]]
    return "\n".join(lines) + "\n"
