"""Exact order statistics and top-k folds that never gather a group in one task.

Quantiles are exact and move almost no data: a first pass sketches the values'
distribution, a second counts rows per (keys, bucket) with map-side combining, and a
third keeps only the rows of the one or two buckets that hold a wanted rank.
Buckets are equal steps between sketched quantiles, a sixteenth of the rows
apart and closer and closer in the tails, so that heavy tails are cut finely too; it
cannot change the answer.

The sketch is one small job when a plan is built; pass ``known`` to share it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.numbers import number

_STEPS, _TAIL, _WITHIN = 16, 11, 512
_SALTS = 128
_BROADCAST_GROUPS = 20_000
_AT_ONCE = 10_000


def _block(value: Column, edges: Sequence, kind: str) -> Column:
    """Between which two edges a value lies: comparisons with literals."""
    return sum(((value >= F.lit(e).cast(kind)).cast("int") for e in edges[1:-1]), F.lit(0))


def _bucket(value: Column, block: Column, edges: Sequence) -> Column:
    """Bucket number, never decreasing in the value: the block, then one of equal steps within it."""
    low, high = (F.get(F.array(*[F.lit(float(e)) for e in some]), block) for some in (edges[:-1], edges[1:]))
    step = F.width_bucket(value.cast("double"), low, high, F.lit(_WITHIN))
    return (block * (_WITHIN + 2) + F.coalesce(step, F.lit(0))).cast("int")


@dataclass(frozen=True)
class Sketch:
    """Bucket edges per measure, and roughly how many groups the keys make."""

    edges: dict[str, list]
    groups: int


def sketch(df: DataFrame, keys: Sequence[str], measures: Sequence[str], typed: bool = False) -> Sketch:
    """One aggregate with a bounded buffer; one row comes back."""
    tails = [2.0**-k for k in range(5, _TAIL)]
    steps = sorted({0.0, 1.0, *tails, *(1 - t for t in tails), *(k / _STEPS for k in range(1, _STEPS))})
    parts = [F.percentile_approx(F.col(m) if typed else number(m), steps, 1_000).alias(m) for m in measures]
    size = F.approx_count_distinct(F.xxhash64(*keys)) if keys else F.lit(1)
    row = df.agg(*parts, size.alias("_groups")).first()
    return Sketch({m: sorted(set(row[m] or [])) for m in measures}, row["_groups"])


def quantiles(df: DataFrame, keys: Sequence[str], measures: Sequence[str], probs: Sequence[float],
              known: Sketch | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles of each measure within each key.

    Columns: keys, ``measure``, ``n`` (values counted) and ``q0``, ``q1``, ...
    ``known`` saves a pass when a sketch of these rows, or of rows that include them, exists.
    """
    pos = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in pos])))
    picked = values_at(df, keys, measures, ranks, known)
    # at most two values per probability and group
    found = picked.groupBy(*keys, "measure", "n").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))
    out = []
    for i, p in enumerate(pos):
        lo, hi = F.element_at("v", F.floor(p)), F.element_at("v", F.ceil(p))
        out.append((lo + (hi - lo) * (p - F.floor(p))).alias(f"q{i}"))
    return found.select(*keys, "measure", "n", *out)


def values_at(df: DataFrame, keys: Sequence[str], measures: Sequence[str], ranks: Column,
              known: Sketch | None = None, typed: bool = False) -> DataFrame:
    """keys, ``measure``, ``n``, ``rank``, ``value`` for the zero-based ``ranks``,
    an array expression over ``n``, the group's number of values.  ``typed``: one
    column is ranked in its own type, not as a double."""
    by = [*keys, "measure"]
    known = known or sketch(df, keys, measures, typed)
    kinds = {m: df.schema[m].dataType.simpleString() if typed else "double" for m in measures}
    wide = df.select(*keys, *[(F.col(m) if typed else number(m)).alias(f"_v{i}") for i, m in enumerate(measures)])
    wide = wide.select("*", *[_block(F.col(f"_v{i}"), known.edges[m], kinds[m]).alias(f"_b{i}") for i, m in enumerate(measures)])
    parts = [F.struct(F.lit(m).alias("measure"), F.col(f"_v{i}").alias("value"), (
        _bucket(F.col(f"_v{i}"), F.col(f"_b{i}"), known.edges[m]) if len(known.edges[m]) > 1 else F.lit(0)).alias("bucket"))
        for i, m in enumerate(measures)]
    long = wide.select(*keys, F.inline(F.array(*parts))).where("value is not null")

    hist = long.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("held"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (hist.select(*by, "bucket", "held", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("below"),
                          F.sum("held").over(whole).alias("n"))
              .withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("below")) & (
                  r < F.col("below") + F.col("held"))))
              .where(F.size("ranks") > 0).drop("held"))
    right = wanted.select(*[F.col(c).alias(f"_{c}") for c in [*by, "bucket"]], "below", "n", "ranks")
    same = F.col("bucket") == F.col("_bucket")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    held = [*by, "bucket", "value"]
    if known.groups <= _BROADCAST_GROUPS:
        # few groups by measure: the rows are filtered where they lie
        inside = long.join(F.broadcast(right), same).groupBy(*held, "below", "n", "ranks").agg(
            F.count(F.lit(1)).alias("copies"))
    else:
        # equal values become one row before the shuffled join, however hot they are
        inside = long.groupBy(*held).agg(F.count(F.lit(1)).alias("copies")).join(right, same)
    before = Window.partitionBy(*by, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = inside.withColumn("start", F.col("below") + F.coalesce(F.sum("copies").over(before), F.lit(0)))
    return placed.withColumn("rank", F.explode(F.filter("ranks", lambda r: (r >= F.col("start")) & (
        r < F.col("start") + F.col("copies"))))).select(*by, "n", "rank", "value")


def systematic_sample(df: DataFrame, order: str, points: int) -> DataFrame:
    """``points`` rows spread evenly over the order of a unique numeric column;
    all rows when there are no more than that.  The rows at the chosen positions are found by rank,
    without numbering the whole table."""
    n = F.col("n")
    every = F.transform(F.sequence(F.lit(0), F.lit(points - 1)),
                        lambda i: F.floor(i * (n.cast("double") / points)).cast("long"))
    all_ranks = F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(points)) - 1)
    picked = values_at(df, [], [order], F.when(n > points, every).otherwise(all_ranks), typed=True)
    chosen = picked.select(F.col("value").alias(order))
    # at most `points` rows
    return df.join(F.broadcast(chosen), order, "left_semi")


def _line(df: DataFrame, column: str, shared: int) -> Column | None:
    """A number that never falls as the column grows; of texts the six bytes after
    those that all have in common.  None where the type has no such number."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if kind == T.StringType():
        some = F.hex(F.substring(F.encode(c, "UTF-8"), shared + 1, 6))
        return F.conv(F.rpad(some, 12, "0"), 16, 10).cast("double")
    return None


def page(df: DataFrame, order: Sequence[tuple[str, bool]], start: int, size: int) -> DataFrame:
    """Rows ``start`` to ``start + size`` of the order by (column, descending), nulls last.

    Up to ``_AT_ONCE`` rows are taken from the top.  Beyond, rows are counted in blocks
    between sketched quantiles of the first column, the quantiles' own values being
    blocks by themselves, and only the blocks that the page meets are looked into,
    again by the first column, or by the next where it has one value left.  So a
    page costs a few counting passes and the sort of few rows, however deep it is.
    Where a column gives no blocks (of another type, or different values with equal
    numbers), the block is sorted.  Columns behind the ordered ones are carried."""
    by = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]
    return _page(df, list(order), by, start, size).orderBy(*by)


def _page(df: DataFrame, order: list[tuple[str, bool]], by: list[Column], start: int, size: int) -> DataFrame:
    plain = df.orderBy(*by).offset(start).limit(size)
    if start + size <= _AT_ONCE or not order:
        return plain
    (column, down), shared = order[0], 0
    if _line(df, column, 0) is None:
        return plain
    low, high, blanks = df.agg(F.min(column), F.max(column), F.count_if(F.col(column).isNull())).first()
    if low == high and not (blanks and low is not None):
        return _page(df, order[1:], by, start, size)
    if isinstance(low, str):
        a, b = low.encode(), high.encode()
        shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    value = _line(df, column, shared)
    edges = sorted(set(df.agg(F.percentile_approx(value, [k / 32 for k in range(33)], 1_000)).first()[0]))
    place = sum(((value >= F.lit(e)).cast("int") + (value > F.lit(e)).cast("int") for e in edges), F.lit(0))
    block = F.when(F.col(column).isNull(), F.lit(-1)).otherwise(place)
    # two blocks an edge and one for nulls at most
    counts = {r["block"]: r["n"] for r in df.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) == 1:
        return plain
    out, above = None, 0
    for b in [*sorted(counts.keys() - {-1}, reverse=down), *([-1] if -1 in counts else [])]:
        first, last = max(start, above), min(start + size, above + counts[b])
        if first < last:
            rows = _page(df.where(block == b), order, by, first - above, last - first)
            out = rows if out is None else out.unionByName(rows)
        above += counts[b]
    return df.limit(0) if out is None else out


def top_and_rest(groups: DataFrame, by: Sequence[str], member: str, order: Sequence[Column], limit: int,
                 merge: Sequence[Column]) -> DataFrame:
    """The ``limit`` best members of each ``by`` and one row merging the others.

    ``merge`` are the aggregates that rebuild the group columns from several
    rows, and ``order`` ranks rows by those columns, best first.  Ranking runs in two steps: members are
    spread over salts, each salt keeps its own best and merges what cannot be
    among the best overall, and only those few rows meet per ``by``.  One pass
    over ``groups``, whatever the number of members.

    Adds ``rank`` (null on the merged row) and ``folded`` (members merged).
    """
    salted = groups.withColumn("_salt", F.pmod(F.hash(member), F.lit(_SALTS))).withColumn("_in", F.lit(1))
    near = Window.partitionBy(*by, "_salt").orderBy(*order)
    kept = salted.withColumn("_keep", F.row_number().over(near) <= limit)
    fewer = kept.groupBy(*by, "_salt", "_keep", F.when(F.col("_keep"), F.col(member)).alias(member)).agg(
        *merge, F.sum("_in").alias("_in"))
    far = Window.partitionBy(*by).orderBy(F.desc("_keep"), *order)
    placed = fewer.withColumn("_place", F.row_number().over(far))
    rank = F.when(F.col("_keep") & (F.col("_place") <= limit), F.col("_place"))
    ranked = placed.withColumn("rank", rank).withColumn(member, F.when(rank.isNotNull(), F.col(member)))
    folded = F.when(F.col("rank").isNull(), F.sum("_in")).otherwise(F.lit(0)).cast("long")
    return ranked.groupBy(*by, "rank", member).agg(*merge, folded.alias("folded"))
