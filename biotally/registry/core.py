"""Query registry: a name, a Spark job over the driver tables and, where SQL can say it, an equal oracle text."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biotally.registry.float_columns import FLOAT_COLUMNS
from biotally.registry.oracle_views import VIEWS

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
ORACLES: dict[str, str] = {}
RAW_ORACLES: dict[str, str] = {}

# Two engines add doubles in different orders, so both sides give doubles with nine significant digits, small and large
# values alike. Values a hair below a tie go up with it: a decimal that ends in 5 does not depend on the last bit.
_DIGITS, _UP = 9, 0.5001


def _significant(c: str) -> Column:
    x = F.col(c)
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (_DIGITS - 1))
    per = F.pow(F.lit(10.0), (_DIGITS - 1) - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).when(unit >= 1, F.signum(x) * F.floor(F.abs(x) / unit + _UP) * unit).otherwise(F.signum(x) * F.floor(F.abs(x) * per + _UP) / per)


def _significant_sql(c: str) -> str:
    e = f'floor(log10(abs("{c}")))'
    unit, per = f"pow(10.0::double, {e} - {_DIGITS - 1})", f"pow(10.0::double, {_DIGITS - 1} - {e})"
    return (
        f'case when "{c}" = 0 or isnan("{c}") or isinf("{c}") then "{c}" when {unit} >= 1 then sign("{c}") * floor(abs("{c}") / {unit} + {_UP}::double) * {unit} '
        f'else sign("{c}") * floor(abs("{c}") * {per} + {_UP}::double) / {per} end as "{c}"'
    )


def _rounded(name: str, fn: Job) -> Job:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.withColumns({c: _significant(c) for c, kind in df.dtypes if kind == "double"})

    return run


def job(name: str, oracle: str | None = None, uses: str = "") -> Callable[[Job], Job]:
    """Register a job; ``uses`` names the oracle views its SQL reads (space separated)."""

    def register(fn: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"duplicate query {name}")
        JOBS[name] = _rounded(name, fn)
        if oracle is not None:
            ctes = [f"{v} as ({VIEWS[v]})" for v in uses.split()]
            body = oracle.strip()
            if ctes:
                joined = ",\n".join(ctes)
                start = next((w for w in ("with recursive ", "with ") if body.lower().startswith(w)), "")
                body = f"{start or 'with '}{joined}{',' if start else ''}\n{body[len(start):]}"
            RAW_ORACLES[name] = body
            rounded = ", ".join(_significant_sql(c) for c in FLOAT_COLUMNS.get(name, ()))
            ORACLES[name] = f"select * replace ({rounded}) from ({body}) as result" if rounded else body
        return fn

    return register
