"""Adaptive windows that merge: any key's stream may be counted by many tasks, and only sums meet.

Time is cut into ticks.  A window is a row for each bucket of ticks, with the number of values and their sum; the bucket of a tick is
a function of its age: the older, the more ticks share one, about `room` buckets for each doubling of age.  Buckets only ever merge as
they age, so a window's next state is one aggregate of its old buckets and the new ticks, however many tasks these come from.  Then each key, by now
a few hundred numbers at most, tests all cuts: as long as the means of an older and a newer part differ by more than the bound, the oldest bucket goes.

The sequential window (`operators.estimators.Adwin`) tests every 32 values; this one tests at the end of each block.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.exprs import adwin_bound
from canopy.sources.scratch import staged

ROOM, LEAST_SIDE, LEAST_WIDTH = 5, 6, 10
_LEVELS = 40


def level(tick: str, now: int, room: int = ROOM) -> Column:
    """How often the ticks of a bucket have doubled at the time `now`; `tick` names a column."""
    floors = [((now >> k) - room) << k for k in range(_LEVELS) if (now >> k) >= room]
    return F.expr(" + ".join(["0", *(f"CAST({tick} < {f}L AS INT)" for f in floors)]))


def merged(buckets: DataFrame, keys: list[str], now: int, room: int = ROOM) -> DataFrame:
    """Buckets (keys, tick, n, s), some of which may be single ticks, at the time `now`; tick is a bucket's first."""
    rows = buckets.withColumn("_level", level("tick", now, room))
    rows = rows.groupBy(*keys, "_level", F.expr("shiftright(tick, _level)").alias("_at"))
    return rows.agg(F.min("tick").alias("tick"), F.sum("n").alias("n"), F.sum("s").alias("s")).drop("_level", "_at")


def tested(buckets: DataFrame, keys: list[str], delta: Column) -> DataFrame:
    """keys, start (first tick that stays), changed, rose (the mean, by what went), n and s of what stays, and its buckets (tick, n, s).

    `delta` may depend on the keys.
    """
    upto = Window.partitionBy(*keys).orderBy("tick")
    rows = buckets.withColumns({"_n": F.sum("n").over(upto).cast("double"), "_s": F.sum("s").over(upto).cast("double")})
    ends = F.sort_array(F.collect_list(F.struct("tick", F.col("_n").alias("n"), F.col("_s").alias("s"), F.col("n").alias("own_n"), F.col("s").alias("own_s"))))
    rows = rows.groupBy(*keys).agg(ends.alias("b"), F.max("_n").alias("all_n")).withColumn("all_s", F.element_at("b", -1)["s"])

    def cut(first: Column, end: Column) -> Column:
        """Whether the part from a bucket on up to another's end differs from the rest."""
        n_before, s_before = first["n"] - first["own_n"], first["s"] - first["own_s"]
        n0, n1 = end["n"] - n_before, F.col("all_n") - end["n"]
        gap = F.abs((end["s"] - s_before) / n0 - (F.col("all_s") - end["s"]) / n1)
        return F.when((n0 > LEAST_SIDE) & (n1 > LEAST_SIDE) & (n0 + n1 > LEAST_WIDTH), gap > adwin_bound(n0, n1, delta)).otherwise(F.lit(False))

    stays = F.filter("b", lambda first: ~F.exists("b", lambda end: cut(first, end)))
    rows = rows.withColumn("_first", F.get(stays, F.lit(0)))
    gone = lambda c: F.col("_first")[c] - F.col("_first")[f"own_{c}"]
    stay = F.transform(F.filter("b", lambda x: x["tick"] >= F.col("_first")["tick"]), lambda x: F.struct(x["tick"].alias("tick"), x["own_n"].alias("n"), x["own_s"].alias("s")))
    rows = rows.select(*keys, F.col("_first.tick").alias("start"), stay.alias("buckets"), *(gone(c).alias(f"_{c}") for c in "ns"), *((F.col(f"all_{c}") - gone(c)).alias(c) for c in "ns"))
    rose = F.when(F.col("_n") > 0, F.col("s") / F.col("n") > F.col("_s") / F.col("_n")).otherwise(F.lit(False))
    return rows.select(*keys, "start", (F.col("_n") > 0).alias("changed"), rose.alias("rose"), "n", "s", "buckets")


def adaptive_windows(ticks: DataFrame, keys: list[str], delta: float, blocks: Iterable[int], room: int = ROOM) -> DataFrame:
    """keys, tick (a block's end), changed, start, width and mean of each key's window, from (keys, tick, n, s) with any number of rows a tick.

    A block's end is the first tick after it; ticks beyond the last end are left out.  A key has rows from its first value on, and no key may be null.
    """
    spark, state, made, last = ticks.sparkSession, None, None, 0
    for now in blocks:
        new = ticks.where((F.col("tick") >= last) & (F.col("tick") < now)).select(*keys, "tick", "n", "s")
        told = staged(tested(merged(new if state is None else state.unionByName(new), keys, now, room), keys, F.lit(float(delta))))
        out = told.select(*keys, F.lit(now).cast("long").alias("tick"), "changed", "start", F.col("n").cast("long").alias("width"), (F.col("s") / F.col("n")).alias("mean"))
        made = out if made is None else made.unionByName(out)
        state, last = told.select(*keys, F.inline("buckets")), now
    if made is None:
        empty = ticks.select(*keys, "tick", F.lit(False).alias("changed"), F.col("tick").alias("start"), F.col("n").cast("long").alias("width"), F.lit(0.0).alias("mean"))
        return empty.where("false")
    return made


def oracle_sql(ticks: str, key: str, delta: float, blocks: list[int], room: int = ROOM) -> str:
    """The same in DuckDB, a few tables for each block, as a block's starts decide what the next one reads; `ticks` is a query of (key, tick, n, s)."""
    parts = [f"ticks AS MATERIALIZED ({ticks})", f"w0 AS (SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS start FROM ticks)"]
    cut = f"n0 > {LEAST_SIDE} AND n1 > {LEAST_SIDE} AND n0 + n1 > {LEAST_WIDTH} AND abs(s0 / n0 - s1 / n1) > sqrt((1 / n0 + 1 / n1) * ln(4 * (n0 + n1) * (n0 + n1) / CAST({delta} AS DOUBLE)) / 2)"
    for i, now in enumerate(blocks):
        floors = [((now >> k) - room) << k for k in range(_LEVELS) if (now >> k) >= room]
        parts.append(f"""b{i} AS MATERIALIZED (SELECT {key}, min(tick) AS tick, sum(n) AS n, sum(s) AS s FROM (
  SELECT t.*, len([f FOR f IN {floors}::BIGINT[] IF f > t.tick]) AS level FROM w{i} w JOIN ticks t ON t.{key} = w.{key} AND t.tick >= w.start AND t.tick < {now}) GROUP BY {key}, level, tick // (1 << level)),
c{i} AS (SELECT *, CAST(sum(n) OVER o AS DOUBLE) AS cn, CAST(sum(s) OVER o AS DOUBLE) AS cs, CAST(sum(n) OVER (PARTITION BY {key}) AS DOUBLE) AS an, CAST(sum(s) OVER (PARTITION BY {key}) AS DOUBLE) AS as_, min(tick) OVER (PARTITION BY {key}) AS oldest FROM b{i} WINDOW o AS (PARTITION BY {key} ORDER BY tick)),
p{i} AS (SELECT f.{key}, f.tick, e.cn - (f.cn - f.n) AS n0, f.an - e.cn AS n1, e.cs - (f.cs - f.s) AS s0, f.as_ - e.cs AS s1 FROM c{i} f JOIN c{i} e ON e.{key} = f.{key}),
x{i} AS (SELECT {key}, tick, bool_or(CASE WHEN n0 > 0 AND n1 > 0 THEN {cut} ELSE false END) AS differs FROM p{i} GROUP BY 1, 2),
r{i} AS MATERIALIZED (SELECT c.{key}, c.tick AS start, c.tick > c.oldest AS changed, c.an - (c.cn - c.n) AS n, c.as_ - (c.cs - c.s) AS s FROM c{i} c JOIN x{i} x ON x.{key} = c.{key} AND x.tick = c.tick WHERE NOT differs QUALIFY row_number() OVER (PARTITION BY c.{key} ORDER BY c.tick) = 1),
w{i + 1} AS MATERIALIZED (SELECT w.{key}, coalesce(r.start, w.start) AS start FROM w{i} w LEFT JOIN r{i} r ON r.{key} = w.{key})""")
    rows = " UNION ALL ".join(f"SELECT {key}, CAST({now} AS BIGINT) AS tick, changed, start, CAST(n AS BIGINT) AS width, s / n AS mean FROM r{i}" for i, now in enumerate(blocks))
    return f"WITH {', '.join(parts)} {rows}"
