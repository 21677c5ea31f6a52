"""Order-dependent values over long timelines.

A plain ``Window.partitionBy(video)`` puts a whole video into one task, which
fails when one video holds a large share of all rows. Here every key is cut
into chunks of bounded length along its order. Windows run per (key, chunk),
each chunk is reduced to one small carry row, the carries are scanned per key,
and the result is joined back. The values equal those of the plain window.

Windows and carries read the same shuffle: both branches start from one explicit
repartition and touch every column, so that pruning leaves the two exchanges
identical and Spark reuses the first. The input is computed once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


def time_chunk(column: str, seconds: float) -> Column:
    return F.floor(F.col(column) / F.lit(float(seconds)))


def _col(expr: str | Column) -> Column:
    return F.col(expr) if isinstance(expr, str) else expr


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    lag: Mapping[str, str | Column] | None = None,
    lead: Mapping[str, str | Column] | None = None,
    max_before: Mapping[str, str | Column] | None = None,
    running_sum: Mapping[str, str | Column] | None = None,
    last_seen: Mapping[str, str | Column] | None = None,
    next_seen: Mapping[str, str | Column] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Add window values to ``df``; ``chunk`` must not decrease along ``order``.

    ``lag``/``lead``: value of the neighbouring row. ``max_before``: maximum over
    all earlier rows. ``running_sum``: sum up to and including the row.
    ``last_seen``/``next_seen``: nearest non-null value at or before/after the
    row. ``number``: 1-based position. ``order`` must be total within a key.
    """
    keys, order = list(keys), list(order)
    lag, lead = dict(lag or {}), dict(lead or {})
    max_before, running_sum = dict(max_before or {}), dict(running_sum or {})
    last_seen, next_seen = dict(last_seen or {}), dict(next_seen or {})

    present = F.expr(" and ".join(f"`{c}` is not null" for c in [*keys, CHUNK]))
    keyed = df.withColumn(CHUNK, chunk).where(present).repartition(*keys, CHUNK)
    # Always true, but only at run time: keeps all columns in both branches.
    touched = F.try_add(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(0))
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A frame that runs to the end is worked out anew for every row; backwards it grows row by row.
    onward = Window.partitionBy(*keys, CHUNK).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)

    rank = F.struct(*[F.col(c) for c in order])
    here, summary, carry, final = {}, [], [], {}

    def boxed(expr):  # a struct, so that a null value differs from "no row"
        return F.struct(_col(expr).alias("v"))

    for name, expr in lag.items():
        here[f"_h_{name}"] = F.lag(boxed(expr)).over(local)
        summary.append(F.max_by(boxed(expr), rank).alias(f"_s_{name}"))
        carry.append(F.lag(f"_s_{name}").over(across).alias(f"_c_{name}"))
        final[name] = F.coalesce(F.col(f"_h_{name}"), F.col(f"_c_{name}"))["v"]
    for name, expr in lead.items():
        here[f"_h_{name}"] = F.lead(boxed(expr)).over(local)
        summary.append(F.min_by(boxed(expr), rank).alias(f"_s_{name}"))
        carry.append(F.lead(f"_s_{name}").over(across).alias(f"_c_{name}"))
        final[name] = F.coalesce(F.col(f"_h_{name}"), F.col(f"_c_{name}"))["v"]
    for name, expr in max_before.items():
        here[f"_h_{name}"] = F.max(_col(expr)).over(before)
        summary.append(F.max(_col(expr)).alias(f"_s_{name}"))
        carry.append(F.max(f"_s_{name}").over(earlier).alias(f"_c_{name}"))
        final[name] = F.greatest(F.col(f"_h_{name}"), F.col(f"_c_{name}"))
    for name, expr in running_sum.items():
        here[f"_h_{name}"] = F.sum(_col(expr)).over(upto)
        summary.append(F.sum(_col(expr)).alias(f"_s_{name}"))
        carry.append(F.sum(f"_s_{name}").over(earlier).alias(f"_c_{name}"))
        final[name] = F.coalesce(F.col(f"_h_{name}"), F.lit(0)) + F.coalesce(
            F.col(f"_c_{name}"), F.lit(0)
        )
    for name, expr in last_seen.items():
        value = _col(expr)
        here[f"_h_{name}"] = F.last(value, ignorenulls=True).over(upto)
        summary.append(F.max_by(value, F.when(value.isNotNull(), rank)).alias(f"_s_{name}"))
        carry.append(F.last(f"_s_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}"))
        final[name] = F.coalesce(F.col(f"_h_{name}"), F.col(f"_c_{name}"))
    for name, expr in next_seen.items():
        value = _col(expr)
        here[f"_h_{name}"] = F.last(value, ignorenulls=True).over(onward)
        summary.append(F.min_by(value, F.when(value.isNotNull(), rank)).alias(f"_s_{name}"))
        carry.append(F.last(f"_s_{name}", ignorenulls=True).over(later).alias(f"_c_{name}"))
        final[name] = F.coalesce(F.col(f"_h_{name}"), F.col(f"_c_{name}"))
    if number is not None:
        here[f"_h_{number}"] = F.row_number().over(local)
        summary.append(F.count(F.lit(1)).alias(f"_s_{number}"))
        carry.append(F.sum(f"_s_{number}").over(earlier).alias(f"_c_{number}"))
        final[number] = (
            F.col(f"_h_{number}") + F.coalesce(F.col(f"_c_{number}"), F.lit(0))
        ).cast("long")

    carries = keyed.groupBy(*keys, CHUNK).agg(*summary, F.bit_or(touched).alias("_all")).select(
        *keys, CHUNK, *carry, "_all"
    ).where("_all is not null").drop("_all")
    joined = keyed.withColumns(here).where(touched.isNotNull()).join(carries, [*keys, CHUNK])
    return joined.select(*[F.col(c) for c in df.columns], *[v.alias(k) for k, v in final.items()])


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
    starts: Column, name: str,
) -> DataFrame:
    """Number runs of rows: ``starts`` is true where a new run begins."""
    return ordered(df, keys, order, chunk, running_sum={name: F.when(starts, 1).otherwise(0)})


def top_k_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt_by: Sequence[str],
    salts: int = 64, rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows per key in two steps, so that no key is ranked in one task.

    ``order`` must be total. Each key is first spread over ``salts`` parts by a
    hash of ``salt_by`` and cut to ``k`` rows there, which cannot lose a winner.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), F.lit(salts))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn(rank, F.row_number().over(part))
        .where(F.col(rank) <= k)
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= k)
        .drop("_salt")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, wanted: Mapping[str, float], step: float) -> DataFrame:
    """Exact interpolated quantiles of the non-null values per key, without a buffer of a key's values.

    Equal values are counted, counts are summed along the values in chunks of ``step``, and the two values around each
    rank are picked. Keys without a value have no row.
    """
    keys = list(keys)
    counts = df.select(*keys, value.cast("double").alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = ordered(counts, keys, ["_v"], F.floor(F.col("_v") / F.lit(float(step))), running_sum={"_upto": "_n"})
    ranked = placed.join(counts.groupBy(*keys).agg(F.sum("_n").alias("_total")), keys)
    rank = {name: (F.col("_total") - 1) * F.lit(float(share)) for name, share in wanted.items()}

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= position) & (position < F.col("_upto")), F.col("_v")))

    picked = ranked.groupBy(*keys, "_total").agg(
        *[at(F.floor(r)).alias(f"_lo_{n}") for n, r in rank.items()], *[at(F.ceil(r)).alias(f"_hi_{n}") for n, r in rank.items()])

    def between(name: str) -> Column:
        lo, hi, r = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), rank[name]
        return F.when(lo == hi, lo).otherwise((F.ceil(r) - r) * lo + (r - F.floor(r)) * hi)

    return picked.select(*keys, *[between(n).alias(n) for n in wanted])
