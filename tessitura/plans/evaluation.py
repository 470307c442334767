"""From score rows to the evaluation's tables: summary, criteria, status counts, worklist, clips to judge."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import criteria as C
from ..operators.listening import verdict_clips
from ..operators.scoring import summarize
from ..session import written


def report(inputs: C.Inputs, tag: str) -> dict[str, DataFrame]:
    """All result tables of one candidate; the criteria are computed once and read by the tables that follow."""
    results = written(C.evaluate(inputs), "criteria")
    return {
        "summary": summarize(inputs.candidate), "criteria": results, "status": C.status_counts(results),
        "needs_ears": C.needs_ears(inputs, results), "verdict_clips": verdict_clips(inputs.candidate, tag),
    }


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("errorifexists").option("header", True).csv(f"{path}/{name}")
