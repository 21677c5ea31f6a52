"""Overlap and as-of joins along a timeline, without all-pairs blow-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captrail.operators.ordered import ordered, time_chunk

BIN, LEVEL, CLASS = "_bin", "_level", "_class"
#: A span over more bins than this is long; bins double from level to level until two or three cover it.
LONG = 64
#: Times beyond are binned as this; no span has more levels than fit below it.
FAR = 2.0**53
CLASSES = 256


def _near(t: Column) -> Column:
    return F.greatest(F.lit(-FAR), F.least(F.lit(FAR), t.cast("double")))


def _bin(t: Column, width: float) -> Column:
    return F.floor(_near(t) / F.lit(float(width)))


def _bins(start: Column, end: Column, size: Column) -> Column:
    first = F.floor(_near(start) / size)
    return F.explode(F.sequence(first, F.greatest(first, F.floor(_near(end) / size))))


def _is_long(start: Column, end: Column, width: float) -> Column:
    return F.coalesce(_bin(end, width) - _bin(start, width) > LONG, F.lit(False))


def _in_long_spans(spans: DataFrame, points: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Pairs of a long span (_ls, _le) and a point (_pt) in it.

    A span lies in the bins of the level whose size is just above its length, two or three of them, however long it is. A
    point looks at the levels in use among keys of its hash class: a table of CLASSES times 60 rows at most.
    """
    size = lambda level: F.lit(float(width)) * F.pow(F.lit(2.0), level)
    of_key = F.pmod(F.xxhash64(*keys), F.lit(CLASSES)).cast("int")
    level = F.ceil(F.log2((_near(F.col("_le")) - _near(F.col("_ls"))) / F.lit(float(width)))).cast("int")
    long = spans.where(_is_long(F.col("_ls"), F.col("_le"), width)).withColumn(LEVEL, level)
    levels = F.broadcast(long.select(of_key.alias(CLASS), LEVEL).distinct())
    looking = points.withColumn(CLASS, of_key).join(levels, CLASS).drop(CLASS)
    looking = looking.withColumn(BIN, F.floor(_near(F.col("_pt")) / size(F.col(LEVEL))))
    covered = long.withColumn(BIN, _bins(F.col("_ls"), F.col("_le"), size(F.col(LEVEL))))
    inside = (F.col("_pt") >= F.col("_ls")) & (F.col("_pt") <= F.col("_le"))
    return covered.join(looking, [*keys, LEVEL, BIN]).where(inside).drop(LEVEL, BIN)


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str],
    left_span: tuple[Column, Column], right_span: tuple[Column, Column],
    condition: Column | None = None, width: float = 8.0,
) -> DataFrame:
    """Pairs of rows with equal keys whose closed spans touch.

    Both sides are spread over the time bins they cover and joined on (keys,
    bin); a pair is kept only in the bin holding the later of the two starts,
    so it appears once. A long span stands in the bin of its start alone; what
    starts later within it is found through larger bins. ``condition`` refines
    the match. Columns of the two sides must not clash, except for the keys.
    """
    l = left.withColumns({"_ls": left_span[0], "_le": left_span[1]})
    r = right.withColumns({"_rs": right_span[0], "_re": right_span[1]})

    def spread(df, start, end):
        last = F.when(_is_long(F.col(start), F.col(end), width), F.col(start)).otherwise(F.col(end))
        return df.withColumn(BIN, _bins(F.col(start), last, F.lit(float(width))))

    touch = (F.col("_ls") <= F.col("_re")) & (F.col("_rs") <= F.col("_le"))
    columns = [*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys]]
    where = touch if condition is None else touch & condition
    both = spread(l, "_ls", "_le").join(spread(r, "_rs", "_re"), [*keys, BIN]).where(where)
    both = both.where(F.col(BIN) == _bin(F.greatest("_ls", "_rs"), width)).select(*columns)
    elsewhere = _bin(F.col("_ls"), width) != _bin(F.col("_rs"), width)
    later = _in_long_spans(l, r.withColumn("_pt", F.col("_rs")), keys, width).where(where & elsewhere)
    spans, points = r.withColumnsRenamed({"_rs": "_ls", "_re": "_le"}), l.withColumnsRenamed({"_ls": "_rs", "_le": "_re"})
    earlier = _in_long_spans(spans, points.withColumn("_pt", F.col("_rs")), keys, width).where(F.col("_pt") > F.col("_ls"))
    return both.union(later.select(*columns)).union(earlier.where(where & elsewhere).select(*columns))


def points_in_spans(
    spans: DataFrame, points: DataFrame, keys: Sequence[str],
    span: tuple[Column, Column], point: Column, width: float = 8.0,
) -> DataFrame:
    """Pairs (span, point) with start <= point <= end."""
    s = spans.withColumns({"_ls": span[0], "_le": span[1]})
    p = points.withColumn("_pt", point)
    short = s.where(~_is_long(F.col("_ls"), F.col("_le"), width)).withColumn(BIN, _bins(F.col("_ls"), F.col("_le"), F.lit(float(width))))
    inside = (F.col("_pt") >= F.col("_ls")) & (F.col("_pt") <= F.col("_le"))
    near = short.join(p.withColumn(BIN, _bin(F.col("_pt"), width)), [*keys, BIN]).where(inside).drop(BIN)
    both = near.unionByName(_in_long_spans(s, p, keys, width))
    return both.drop("_ls", "_le", "_pt")


def asof_join(
    points: DataFrame, facts: DataFrame, keys: Sequence[str], point: str, fact: str,
    fact_order: Sequence[str], name: str, *, forward: bool = False, chunk_seconds: float = 600.0,
) -> DataFrame:
    """For each point the last fact at or before it (or the first at or after).

    Adds the fact row as struct column ``name`` (null when there is none). Ties
    in time are decided by ``fact_order``. Points and facts share one ordered
    pass per (keys, chunk), so the cost is a sort, not a product.
    """
    payload = F.struct(*[F.col(c) for c in facts.columns])
    blank = F.lit(None)
    f_rows = facts.select(
        *[F.col(k) for k in keys], F.col(fact).cast("double").alias("_t"),
        F.lit(1 if forward else 0).alias("_side"),
        F.struct(*[F.col(c) for c in fact_order]).alias("_ord"), payload.alias(name),
        blank.cast(points.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_pt"),
    )
    p_rows = points.select(
        *[F.col(k) for k in keys], F.col(point).cast("double").alias("_t"),
        F.lit(0 if forward else 1).alias("_side"),
        blank.cast(f_rows.schema["_ord"].dataType).alias("_ord"),
        blank.cast(f_rows.schema[name].dataType).alias(name),
        F.struct(*[F.col(c) for c in points.columns]).alias("_pt"),
    )
    rows = f_rows.unionByName(p_rows)
    seen = {("next_seen" if forward else "last_seen"): {"_hit": name}}
    out = ordered(
        rows, keys, ["_t", "_side", "_ord"], time_chunk("_t", chunk_seconds), **seen
    )
    return out.where("_pt is not null").select("_pt.*", F.col("_hit").alias(name))
