"""Building blocks of the analytical operators: versions, scopes, buckets, guarded statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.scratch import materialize


def latest(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the newest version for each key; Spark limits the groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def in_scope(df: DataFrame, sources: Sequence[str] | None = None, metric: str | None = None, start: str | None = None, end: str | None = None, time: str = "timestamp", closed: bool = False) -> DataFrame:
    """Conjunction of the filters that are given; [start, end), or [start, end] if closed."""
    if start is not None and end is not None and not start < end:
        raise ValueError("end must be after start")
    if sources is not None:
        if not sources:
            raise ValueError("an empty scope")
        df = df.where(F.col("source").isin(*sources))
    if metric is not None:
        df = df.where(F.col("metric_name") == metric)
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bound = F.lit(end).cast("timestamp_ntz")
        df = df.where(F.col(time) <= bound if closed else F.col(time) < bound)
    return df


def bucket(time: Column | str, resolution: str, week_start: str = "monday") -> Column:
    """Start of the bucket: 5min, hourly, daily, weekly or monthly. Metrics count weeks from Sunday, revisions from Monday."""
    time = F.col(time) if isinstance(time, str) else time
    if resolution == "5min":
        stamp = F.unix_timestamp(time.cast("timestamp"))
        return F.timestamp_seconds(stamp - stamp % 300).cast("timestamp_ntz")
    if resolution == "weekly" and week_start == "sunday":
        return (F.date_trunc("week", time + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    unit = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}.get(resolution)
    if unit is None:
        raise ValueError(f"unknown resolution {resolution}")
    return F.date_trunc(unit, time).cast("timestamp_ntz")


#: Rows that a read may return, as multiples of the base cap.
CAP_FACTOR = {"5min": 1, "hourly": 12, "daily": 288, "weekly": 2016, "monthly": 8640}


def row_cap(resolution: str, base: int = 10_000) -> int:
    return base * CAP_FACTOR[resolution]


def guarded_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson's r as an aggregate; null for fewer than two pairs or without variance."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    return F.when(spread > 0, F.try_divide(F.covar_samp(a, b), spread))


#: Rows of a group up to which one task ranks it.
ONE_TASK = 2_000_000
#: Equal-width buckets that narrow the search for a quantile.
BUCKETS = 4096


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """The element at index floor(p * n) of the sorted values of every group. Groups of a checked size are ranked by a window; else no task sorts a group:

    bucket counts, at most BUCKETS for a group, say in which bucket each
    quantile lies; only those buckets are looked at value by value, and equal
    values are one row by then.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= ONE_TASK:
        part = Window.partitionBy(*(keys or [F.lit(1)]))
        at = rows.withColumn("_n", F.count(F.lit(1)).over(part)).withColumn("_i", F.row_number().over(part.orderBy("_v")) - 1)
        return at.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == F.least(F.floor(F.lit(p) * F.col("_n")), F.col("_n") - 1), F.col("_v"))).alias(f"p{round(p * 100):02d}") for p in ps])
    frame = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    # one row for each group; without groups a single row
    at = rows.join(frame, keys) if keys else rows.join(F.broadcast(frame))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0))
    values = at.groupBy(*keys, place.cast("int").alias("_b"), "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    counts = at.groupBy(*keys, place.cast("int").alias("_b")).agg(F.count(F.lit(1)).alias("_m"), F.first("_n").alias("_n"))
    order = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("_end", F.sum("_m").over(order)).withColumn("_start", F.col("_end") - F.col("_m"))
    ranks = [F.least(F.floor(F.lit(p) * F.col("_n")), F.col("_n") - 1) for p in ps]
    wanted = None
    for r in ranks:
        hit = (r >= F.col("_start")) & (r < F.col("_end"))
        wanted = hit if wanted is None else wanted | hit
    near = values.join(ends.where(wanted).select(*keys, "_b", "_start"), [*keys, "_b"])
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_end", F.col("_start") + F.sum("_c").over(inside)).withColumn("_from", F.col("_end") - F.col("_c"))
    cols = [F.max(F.when((r >= F.col("_from")) & (r < F.col("_end")), F.col("_v"))).alias(f"p{round(p * 100):02d}") for p, r in zip(ps, ranks, strict=True)]
    return near.groupBy(*keys).agg(*cols)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str = "r", size: str = "n") -> DataFrame:
    """df with the rank of each row (from 1) in its group and the group's size.

    Groups of a checked size are ranked by a window. Where one is larger, rows
    are dealt by range of keys and order instead, written, and ranked as their
    place in a range plus what came before: no task holds a group.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
    if (sizes.agg(F.max(size)).first()[0] or 0) <= ONE_TASK:
        part = Window.partitionBy(*keys)
        return df.withColumn(size, F.count(F.lit(1)).over(part)).withColumn(rank, F.row_number().over(part.orderBy(*order)))
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("_part", F.shiftright("_at", 33)), "ranked")
    pieces = dealt.groupBy("_part", *keys).agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_m"))
    before = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn(size, F.sum("_m").over(Window.partitionBy(*keys))).drop("_m")
    names = {k: f"_key{i}" for i, k in enumerate(keys)} | {"_part": "_piece"}
    pieces = pieces.withColumnsRenamed(names)
    same = F.col("_part") == F.col("_piece")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(names[k]))
    return dealt.join(pieces, same).select(*df.columns, size, (F.col("_at") - F.col("_least") + F.col("_before") + 1).alias(rank))


def top_with_tail(df: DataFrame, order: Sequence[Column], n: int, weight: str) -> DataFrame:
    """The first n rows and, in each, the summed weight of the rest."""
    top = df.orderBy(*order).limit(n)
    total = df.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("_all"))
    shown = top.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("_shown"))
    return top.join(F.broadcast(total.join(F.broadcast(shown))), how="left").withColumn("other", F.col("_all") - F.col("_shown")).drop("_all", "_shown")


def page_after(df: DataFrame, cursor: Mapping[str, Column], n: int) -> DataFrame:
    """The n rows that follow the cursor in the order of its columns; no offset is counted off."""
    later = F.lit(False)
    for c in reversed(cursor):
        later = (F.col(c) > cursor[c]) | ((F.col(c) == cursor[c]) & later)
    return df.where(later).orderBy(*cursor).limit(n)


def with_array_value(df: DataFrame, facts: DataFrame, field: str, value: str, key: str = "article_id") -> DataFrame:
    """Facet filter: rows whose article has the value among those of a metadata field."""
    has = facts.where((F.col("field") == field) & F.array_contains("value", value)).select(key)
    return df.join(has, key, "left_semi")


def sentiment_band(value: Column, band: str) -> Column:
    """Predicate of a band: negative (<= -0.05), neutral, positive (>= 0.05)."""
    bands = {"negative": value <= -0.05, "neutral": (value > -0.05) & (value < 0.05), "positive": value >= 0.05}
    if band not in bands:
        raise ValueError(f"unknown band {band}")
    return bands[band]


def contains_ci(text: Column, part: str) -> Column:
    return F.instr(F.lower(text), F.lit(part.lower())) > 0


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays of equal length; null where one is zero or null."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.lit(1.0) - F.try_divide(dot(a, b), F.when(norm > 0, norm))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for a row and not again for each element that a function in use runs over."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(values: Column) -> Column:
    """Shares of e to the power of each value; the largest is taken off first, so that none overflows."""
    powers = held(values, lambda x: held(F.array_max(x), lambda most: F.transform(x, lambda v: F.exp(v - most))))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return held(powers, lambda x: held(total(x), lambda t: F.transform(x, lambda v: v / t)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \n\t]+"), lambda w: w != ""))
