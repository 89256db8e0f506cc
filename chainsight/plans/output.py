"""Output shaping shared by registered queries: doubles rounded to a fixed scale.

Rounding is computed as ``round(x * 10^k) / 10^k`` so that it performs the
same floating-point steps as DuckDB's ``round(x, k)`` on doubles; a plain
decimal HALF_UP round can differ from it on exact decimal ties.

Addition order differs between engines, so every double leaving a checked
query is rounded (6 dp by default) on both the Spark and the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, FloatType


def round_doubles(df: DataFrame, scale: int = 6, overrides: dict[str, int] | None = None,
                  skip: tuple[str, ...] = ("close",)) -> DataFrame:
    """Round every double column; ``skip`` lists inputs passed through unchanged (same bits in both engines)."""
    overrides = overrides or {}
    out = []
    for f in df.schema.fields:
        q = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (DoubleType, FloatType)) and f.name not in skip:
            # round(x * 10^k) / 10^k: the same IEEE steps the oracle engine uses for round(x, k),
            # so exact decimal ties (e.g. 0.5153125) round alike on both sides
            m = f"{10 ** overrides.get(f.name, scale)}D"
            out.append(f"round({q} * {m}, 0) / {m} AS {q}")
        else:
            out.append(q)
    # one selectExpr call instead of three Column objects per column through py4j
    return df.selectExpr(*out)
