"""Formulas as short programs, applied to DataFrames or printed as standard SQL.

A program is a list of lines ``name = expression`` over columns and earlier names.
Expressions are SQL that Spark and DuckDB read alike; numbers with a point or exponent
are doubles; ``nx(c, k)`` and ``ny(c, k)`` are the value of c k cells further along i or
j (null beyond the grid). Lines that don't need each other share one projection, so that
Catalyst fuses a whole program into few code-generated stages and evaluates a name once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMBER = re.compile(r"(?<![\w.'])(\d+\.\d*(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)(?![\w.'])")
_NEAR = re.compile(r"\bn([xy])\((\w+), ?(-?\d+)\)")
_NAME = re.compile(r"[A-Za-z_]\w*")


def text(expression: str) -> str:
    """An expression as SQL."""

    def near(m: re.Match) -> str:
        k = int(m[3])
        along, across = ("i", "j") if m[1] == "x" else ("j", "i")
        return m[2] if k == 0 else f"{'lead' if k > 0 else 'lag'}({m[2]}, {abs(k)}) OVER (PARTITION BY {across} ORDER BY {along})"

    return _NUMBER.sub(r"CAST('\1' AS DOUBLE)", _NEAR.sub(near, expression))


class Program:
    """Lines grouped into levels, each one projection.

    All that can be made with windows along one axis is made before the other axis is
    turned to, so that a step over a grid needs one exchange for each axis.
    """

    def __init__(self, *lines: str):
        self.lines = [tuple(x.strip() for x in line.split("=", 1)) for part in lines for line in ([part] if isinstance(part, str) else part)]
        names = [name for name, _ in self.lines]
        if len(set(names)) < len(names):
            raise ValueError(f"{next(n for n in names if names.count(n) > 1)} is set twice")
        earlier = {name: {x for x in _NAME.findall(expr) if x in names[:n]} for n, (name, expr) in enumerate(self.lines)}
        axes = {name: {m[1] for m in _NEAR.finditer(expr)} for name, expr in self.lines}
        self.levels: list[list[tuple[str, str]]] = []
        left, made, axis = list(self.lines), set(), "x"
        idle = 0
        while left:
            ready = [x for x in left if earlier[x[0]] <= made and axes[x[0]] <= {axis}]
            if not ready and idle:  # a line with windows along both axes
                ready = [x for x in left if earlier[x[0]] <= made]
            if ready:
                self.levels.append(ready)
                made |= {name for name, _ in ready}
                left = [x for x in left if x[0] not in made]
                idle = 0
            else:
                axis, idle = "y" if axis == "x" else "x", 1

    def apply(self, df: DataFrame) -> DataFrame:
        for level in self.levels:
            df = df.withColumns({name: F.expr(text(expr)) for name, expr in level})
        return df

    def sql(self, source: str) -> str:
        """The program over a table or subquery, as nested selections."""
        out = source if re.fullmatch(r"\w+", source) else f"({source})"
        for n, level in enumerate(self.levels):
            made = ", ".join(f"{text(expr)} AS {name}" for name, expr in level)
            out = f"(SELECT *, {made} FROM {out} AS p{n})"
        return f"SELECT * FROM {out} AS p"


class Chain:
    """Programs one after the other on a state: each renames its results to the state's names.

    A stage is (lines, {column: result}); columns that it doesn't name keep their values.
    """

    def __init__(self, columns: list[str], *stages: tuple[list[str], dict[str, str]]):
        self.columns, self.stages = columns, [(Program(lines), names) for lines, names in stages]

    def apply(self, df: DataFrame) -> DataFrame:
        for program, names in self.stages:
            df = program.apply(df).select(*[F.col(names.get(c, c)).alias(c) for c in self.columns])
        return df

    def sql(self, source: str) -> str:
        for n, (program, names) in enumerate(self.stages):
            picked = ", ".join(f"{names.get(c, c)} AS {c}" for c in self.columns)
            source = f"SELECT {picked} FROM ({program.sql(source)}) AS c{n}"
        return source


def rounded(*names: str, digits: int = 9) -> list[str]:
    """Expressions that round doubles alike in both engines, without a negative zero."""
    return [f"round({n}, {digits}) + CAST('0.0' AS DOUBLE) AS {n}" for n in names]
