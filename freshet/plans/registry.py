"""All registered queries of the flood engine and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.program import Program, rounded, text
from freshet.plans import fixtures as fx

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "flagship_srm_hllc_step"


def add(name: str, build: Callable, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = sql


def pointwise(name: str, lines: list[str], out: list[str], where: str = "", keys=("i", "j"), source: Callable | None = None, cte: str = fx.CELL, view: str = "cell", exact: tuple = (), digits: int = 9) -> None:
    """A program over a grid: doubles in ``out`` are rounded, columns in ``exact`` are not."""
    program = Program(lines)
    shown = [*keys, *exact, *rounded(*out, digits=digits)]
    source = source or fx.cell

    def build(spark, sf_dir: str) -> DataFrame:
        df = program.apply(source(spark, sf_dir))
        return (df.where(text(where)) if where else df).select(*[F.expr(x) for x in shown])

    rule = f" WHERE {text(where)}" if where else ""
    add(name, build, f"WITH {cte} SELECT {', '.join(shown)} FROM ({program.sql(view)}) AS r{rule}")


from freshet.plans import queries_flow, queries_grid, queries_more, queries_tables  # noqa: E402, F401  (they register)
