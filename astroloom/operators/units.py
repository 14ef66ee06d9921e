"""Values recorded in different units, brought to common units (problem 1)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from astroloom.functions.units import parse_unit, split_raw

_PARSED = T.StructType([T.StructField(name, T.DoubleType()) for name in ("value", "log_cgs", "a_power", "h_power")])


@F.pandas_udf(_PARSED)
def _from_text(quantity: pd.Series, number: pd.Series, unit_text: pd.Series, raw_text: pd.Series) -> pd.DataFrame:
    rows = []
    for q, n, u, raw in zip(quantity, number, unit_text, raw_text):
        raw = None if raw is None or raw != raw else raw
        unit = parse_unit(None if u is None or u != u else u, q)
        value, raw_unit = split_raw(raw) if raw is not None and (unit is None or n != n) else (None, None)
        value = n if n == n and n is not None else value
        unit = unit or parse_unit(raw_unit, q)
        rows.append((value, *unit) if unit and value is not None else (None,) * 4)
    return pd.DataFrame(rows, columns=["value", "log_cgs", "a_power", "h_power"], dtype="float64")


def to_code_units(values: DataFrame, snapshots: DataFrame, code_units: DataFrame) -> DataFrame:
    """``values`` with ``code_value``: the number in the common unit of its quantity, null if no unit is usable.

    Where ``cgs_factor`` is given the numeric attributes decide, an absent exponent being 0; else the unit text;
    else the unit that stands with the number in the raw text. Physical cgs value = number · factor · a^p · h^q with
    the scale factor a and h of the snapshot; the common unit itself may hold a power of a. No value is usable if
    the number is null, NaN or infinite, the factor is not positive and finite, the unit text is unknown or has
    another dimension than the quantity, or the snapshot or quantity is unknown while it is needed. Every input row
    comes out once, in no order; ``snapshots`` and ``code_units`` are header tables of one row per snapshot and
    quantity (repeated rows of them would repeat the output, so they are made distinct by key).

    Only rows without attributes pass through Python, in Arrow batches; no exchange takes place.
    """
    # The header tables grow with neither the values nor the runs: one row per snapshot number and per quantity.
    heads = snapshots.dropDuplicates(["snap_id"]).select(F.col("snap_id").alias("__snap"), F.col("scale_factor").alias("__a"), F.col("h").alias("__h"))
    units = code_units.dropDuplicates(["quantity"]).select(F.col("quantity").alias("__quantity"), F.col("unit_cgs").alias("__cgs"), F.col("a_exponent").cast("double").alias("__a_exp"))
    by_attributes = F.col("cgs_factor").isNotNull() & ~F.isnan("cgs_factor")
    number = F.col("num_value").cast("double")

    attributed = values.where(by_attributes).withColumns({
        "__v": number,
        "__log": F.when(F.col("cgs_factor") > 0, F.log10("cgs_factor")),
        "__ap": F.coalesce(F.nanvl("a_scale_exponent", F.lit(0.0)), F.lit(0.0)),
        "__hp": F.coalesce(F.nanvl("h_scale_exponent", F.lit(0.0)), F.lit(0.0)),
    })
    texts = values.where(F.coalesce(~by_attributes, F.lit(True))).withColumn("__p", _from_text("quantity", number, "unit_text", "raw_text"))
    texts = texts.withColumns({"__v": F.col("__p.value"), "__log": F.col("__p.log_cgs"), "__ap": F.col("__p.a_power"), "__hp": F.col("__p.h_power")}).drop("__p")

    def power(base: str, exponent: F.Column) -> F.Column:
        return F.when(exponent == 0, F.lit(1.0)).otherwise(F.pow(F.col(base), exponent))

    out = attributed.unionByName(texts).join(heads, F.col("snap_id") == F.col("__snap"), "left").join(units, F.col("quantity") == F.col("__quantity"), "left")
    value = F.col("__v") * F.pow(F.lit(10.0), F.col("__log") - F.log10("__cgs")) * power("__a", F.col("__ap") - F.col("__a_exp")) * power("__h", F.col("__hp"))
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return out.withColumn("code_value", F.when(usable, value)).drop("__v", "__log", "__ap", "__hp", "__snap", "__a", "__h", "__quantity", "__cgs", "__a_exp")


def conflicting_pairs(values: DataFrame, keys: list[str], id_column: str, value: str, tolerance: float = 0.05) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose values differ by more than ``tolerance`` of the larger magnitude.

    Output ``<id>_lo, <id>_hi``, each pair once. Rows with a null or NaN value, id or key take no part; values that
    are both 0 agree. A key whose smallest and largest value agree holds no such pair and is dropped before any
    join. Within a key, values fall into bins so narrow that one bin never holds a conflict; only rows of
    different bins meet, so a key with a third of all rows and one common value costs nothing, and one with many
    outliers costs what its output needs (the join partners of a hot key are split by adaptive execution).
    """
    rows = values.select(*keys, F.col(id_column).alias("__id"), F.col(value).cast("double").alias("__x")).dropna()
    rows = rows.where(~F.isnan("__x"))
    differ = lambda x, y: F.abs(x - y) > F.lit(tolerance) * F.greatest(F.abs(x), F.abs(y))
    step = -0.999 * F.log1p(F.lit(-tolerance))
    rows = rows.withColumn("__bin", F.when(F.col("__x") == 0, F.lit(0)).otherwise(F.signum("__x") * (F.floor(F.log(F.abs("__x")) / step) + 1_000_000)).cast("long"))
    bins = rows.groupBy(*keys, "__bin").agg(F.min("__x").alias("__low"), F.max("__x").alias("__high"))
    ends = bins.groupBy(*keys).agg(F.min("__low").alias("__least"), F.max("__high").alias("__most")).where(differ(F.col("__least"), F.col("__most"))).select(*keys)
    bins = bins.join(ends, keys, "left_semi")
    other = bins.select(*keys, F.col("__bin").alias("__bin2"), F.col("__low").alias("__low2"), F.col("__high").alias("__high2"))
    # bins of one key are bounded in number by the range of a double over the bin width
    paired = bins.join(other, keys).where(F.col("__bin") < F.col("__bin2")).where(differ(F.col("__low"), F.col("__high2")) | differ(F.col("__high"), F.col("__low2")) | differ(F.col("__low"), F.col("__low2")))
    left = paired.select(*keys, "__bin", "__bin2").join(rows, [*keys, "__bin"])
    right = rows.select(*keys, F.col("__bin").alias("__bin2"), F.col("__id").alias("__id2"), F.col("__x").alias("__x2"))
    pairs = left.join(right, [*keys, "__bin2"]).where(differ(F.col("__x"), F.col("__x2")))
    return pairs.select(F.least("__id", "__id2").alias(f"{id_column}_lo"), F.greatest("__id", "__id2").alias(f"{id_column}_hi"))
