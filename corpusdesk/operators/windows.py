"""Ordered lookups that stay parallel when one key holds a large share of all rows.

A plain window puts all rows of a key into one task.  Here a key is cut into
buckets of the ordering column (a day, a block of positions).  Rows look back
inside their bucket; what earlier buckets contribute is one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def last_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, bucket: Column) -> DataFrame:
    """Adds ``out``: the latest non-null ``value`` on an earlier row of the key.

    ``bucket`` must not decrease along ``order``.
    """
    df = df.withColumn("_bucket", bucket)
    here = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("_inside", F.last(value, ignorenulls=True).over(here))
    stamp = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = df.groupBy(*keys, "_bucket").agg(F.max_by(value, stamp).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    # null-safe, so that rows with a null key or place are kept
    names = {k: f"_key{i}" for i, k in enumerate([*keys, "_bucket"])}
    carried = carried.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return (
        inside.join(carried, same)
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_inside", "_carried", "_bucket", *names.values())
    )


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str,
              value: str, out: str, bucket, inclusive: bool = False) -> DataFrame:
    """Each left row with the latest right ``value`` before it (or at it, if inclusive).

    ``bucket`` maps the ordering Column to its bucket.  Left rows need no unique id.
    A left row with a null key or time is kept and finds nothing.
    """
    for c in (*keys, right_order):
        right = right.where(F.col(c).isNotNull())
    side_left, side_right = (1, 0) if inclusive else (0, 1)
    kind = {f.name: f.dataType for f in right.schema.fields}[value]
    l_rows = left.withColumns({"_at": F.col(left_order), "_side": F.lit(side_left), "_value": F.lit(None).cast(kind)})
    r_rows = right.select(*keys, F.col(right_order).alias("_at"), F.lit(side_right).alias("_side"), F.col(value).alias("_value"))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    looked = last_before(both, keys, ["_at", "_side"], "_value", out, bucket(F.col("_at")))
    found = F.when(F.col("_at").isNotNull(), F.col(out))
    return looked.where(F.col("_side") == side_left).withColumn(out, found).drop("_at", "_side", "_value")


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, session_start, last_seen, events): a pause of ``gap_seconds`` ends a session.

    Events are first reduced to cells half as wide as the gap, in which no pause
    can occur.  The reduction runs map-side, so a busy key reaches the window as
    a number of cells that depends on time, not on its number of events.
    """
    micros = F.unix_micros(F.col(ts))
    width = gap_seconds * 500_000
    cells = events.groupBy(key, F.floor(micros / width).alias("_cell")).agg(
        F.min(micros).alias("_lo"), F.max(micros).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_cell")
    starts = cells.withColumn(
        "_new", F.when(F.col("_lo") - F.lag("_hi").over(w) < gap_seconds * 1_000_000, 0).otherwise(1))
    numbered = starts.withColumn("_no", F.sum("_new").over(w))
    return numbered.groupBy(key, "_no").agg(
        F.timestamp_micros(F.min("_lo")).alias("session_start"),
        F.timestamp_micros(F.max("_hi")).alias("last_seen"),
        F.sum("_n").alias("events"),
    ).drop("_no")


def active_sessions(found: DataFrame, now: Column, gap_seconds: int) -> DataFrame:
    """One row: sessions that had not gone idle at ``now``."""
    open_ = (F.col("session_start") <= now) & (F.col("last_seen") + F.make_dt_interval(secs=F.lit(gap_seconds)) > now)
    return found.agg(F.count_if(open_).alias("active"))
