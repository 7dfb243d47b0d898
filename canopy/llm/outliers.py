"""Quality rules: counts of words, symbols and repetitions by plain rules, then robust multivariate outliers among the rows that pass them.

The statistics of a text become four numbers (logarithms of its mean word length, and of one more than
its symbols, repeated lines and repeated words for 100 words), rounded to whole steps.  For each language and source the minimum-covariance-determinant estimate is sought: the half
of the rows with the smallest covariance.  Three starts (medians and quartile ranges; plain mean and covariance; those of values clipped around
the median) take concentration steps, each of which fits mean and covariance to the rows nearest by the last fit; the start of smallest determinant goes
on to the end.  The rows within the 0.975 quantile of its distances give the final estimate, and a row is rejected if its squared Mahalanobis distance
exceeds the quantile of chi-squared with four degrees of freedom that one normal row in a million exceeds.

All is DataFrame expressions and aggregates.  A step needs only sums of products and a percentile of whole numbers (distances in 1/64, up to 100)
by group, both of which merge by task, so that a hot source is no hot task; equal statistic vectors are counted once with their number.  As sums are of
whole numbers, results don't depend on how rows are split.

Covariances get a floor on their diagonal: the spread of each statistic that is of no interest.  So many equal rows (copies, or texts without any symbol) don't shrink an
estimate to a point.  Length itself is no fault, and no part of the vector.

Odd rows.  A null text is empty: no words, and rejected by the rules.  A null language or source is a value of its own.  Groups of fewer than `least`
rows are pooled by language, languages that then have fewer are pooled together, and rows of what is left are kept.  Repeated rows and ids are answered
each, an empty table has no rows.  Other columns are not in the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import small_or_plain, staged

_SPACE, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
D = 4
_Z = tuple(f"z{i}" for i in range(1, D + 1))
_PAIRS = tuple((i, j) for i in range(1, D + 1) for j in range(1, i + 1))
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class OutlierParams:
    #: Rules: the fewest words, and the most words of 100 in repeated windows of three.
    least_words: int = 50
    most_repeated: int = 50
    #: Steps of a statistic's logarithm.
    unit: int = 256
    #: The spread of each statistic that is allowed anywhere, in logarithms.
    floors: tuple[float, ...] = (0.06, 0.5, 0.5, 0.8)
    #: The fewest rows that make an estimate of their own.
    least: int = 50
    #: Share of the rows whose covariance is sought, and of those that the final estimate is of.
    half: float = 0.5
    inner: float = 0.975
    #: Share of normal rows that are rejected.
    tail: float = 1e-6
    #: Concentration steps of all starts, and more of the best.
    first_steps: int = 2
    more_steps: int = 6


def chi4(x: float) -> float:
    """Distribution of chi-squared with four degrees of freedom."""
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def chi4_quantile(p: float) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(200):
        lo, hi = ((lo + hi) / 2, hi) if chi4((lo + hi) / 2) < p else (lo, (lo + hi) / 2)
    return lo


def consistency(p: float) -> float:
    """What the covariance of a normal sample's innermost share is to be multiplied by."""
    x = chi4_quantile(p)
    return p / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, and n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the column text, all long."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("_text")).withColumn("_words", F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.select(
        *keep,
        "_words",
        F.size("_words").alias("_n"),
        F.length(F.translate("_text", _SPACE, "")).alias("_chars"),
        (F.length("_text") - F.length(F.translate("_text", _SYMBOLS, ""))).alias("_symbols"),
        F.filter(F.split("_text", "\n", -1), lambda x: F.translate(x, _SPACE, "") != "").alias("_lines"),
    )
    window = lambda x, i: F.struct(F.concat_ws(" ", x, F.get("_words", i + 1), F.get("_words", i + 2)).alias("t"), i.alias("i"))
    windows = F.array_sort(F.transform(F.slice("_words", 1, F.greatest(F.col("_n") - 2, F.lit(0))), window))
    rows = rows.select(*keep, "_n", "_chars", "_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_dups"), windows.alias("_sorted"))
    same = lambda x, i: F.coalesce(F.get("_sorted", i)["t"] == x["t"], F.lit(False))
    again = F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    told = ("_n", "_chars", "_symbols", "_dups", covered)
    return rows.select(*keep, *((F.col(c) if isinstance(c, str) else c).cast("long").alias(n) for c, n in zip(told, _BASE, strict=True)))


# Expressions that Spark and DuckDB read alike; both work them out in the same order.


def failed_sql(p: OutlierParams) -> str:
    return f"n_words < {p.least_words} OR 100 * n_repeat_words > {p.most_repeated} * n_words"


def transformed_sql(p: OutlierParams) -> list[str]:
    """z1 to z4 of rows with words."""
    shares = ["CAST(word_chars AS DOUBLE) / n_words", *(f"1 + 100 * CAST({c} AS DOUBLE) / n_words" for c in _BASE[2:])]
    return [f"CAST(floor(ln({x}) * {p.unit} + 0.5) AS BIGINT) AS {z}" for x, z in zip(shares, _Z, strict=True)]


def sums_sql(weight: str, values: tuple[str, ...] = _Z) -> list[str]:
    """Number, sums and sums of products, whole."""
    z = dict(zip(range(1, D + 1), values, strict=True))
    products = [f"CAST(sum({weight} * {z[i]} * {z[j]}) AS BIGINT) AS p{i}{j}" for i, j in _PAIRS]
    return [f"CAST(sum({weight}) AS BIGINT) AS n", *(f"CAST(sum({weight} * {z[i]}) AS BIGINT) AS s{i}" for i in z), *products]


def covariance_sql(factor: float, p: OutlierParams) -> list[str]:
    """Means and covariances with their floors from sums."""
    floor = {i: (f * p.unit) ** 2 for i, f in enumerate(p.floors, 1)}
    mean = {i: f"CAST(s{i} AS DOUBLE) / n" for i in floor}
    cov = lambda i, j: f"CAST({factor!r} AS DOUBLE) * (CAST(p{i}{j} AS DOUBLE) / n - ({mean[i]}) * ({mean[j]}))" + (f" + CAST({floor[i]!r} AS DOUBLE)" if i == j else "")
    return [*(f"{mean[i]} AS m{i}" for i in floor), *(f"{cov(i, j)} AS v{i}{j}" for i, j in _PAIRS)]


def cholesky_sql() -> list[list[str]]:
    """Lower factor l of v in steps, each of which reads the columns of those before; at the end size, the root of the determinant."""
    steps = []
    for j in range(1, D + 1):
        left = "".join(f" - l{j}{k} * l{j}{k}" for k in range(1, j))
        steps.append([f"sqrt(v{j}{j}{left}) AS l{j}{j}"])
        if j < D:
            steps.append([f"(v{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j)) + f") / l{j}{j} AS l{i}{j}" for i in range(j + 1, D + 1)])
    return [*steps, [" * ".join(f"l{i}{i}" for i in range(1, D + 1)) + " AS size"]]


def distance_sql() -> list[list[str]]:
    """Squared Mahalanobis distance d2 of z, in steps."""
    steps = [[f"((z{i} - m{i})" + "".join(f" - l{i}{k} * y{k}" for k in range(1, i)) + f") / l{i}{i} AS y{i}"] for i in range(1, D + 1)]
    return [*steps, [" + ".join(f"y{i} * y{i}" for i in range(1, D + 1)) + " AS d2"]]


_BUCKET = "CAST(floor(least(sqrt(d2), 100) * 64) AS BIGINT)"
_FIT = [*(f"m{i}" for i in range(1, D + 1)), *(f"l{i}{j}" for i, j in _PAIRS), "size"]


def _stepped(rows: DataFrame, steps: list[list[str]]) -> DataFrame:
    for step in steps:
        rows = rows.selectExpr("*", *step)
    return rows


def _fitted(sums: DataFrame, keys: list[str], factor: float, p: OutlierParams) -> DataFrame:
    return staged(_stepped(sums.selectExpr(*keys, *covariance_sql(factor, p)), cholesky_sql()).select(*keys, *_FIT))


def _sums(rows: DataFrame, keys: list[str], values: tuple[str, ...] = _Z) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.expr(x) for x in sums_sql("w", values)))


def _measured(vectors: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    rows = _stepped(vectors.join(small_or_plain(fits, 100_000), "grp"), distance_sql())
    return rows.select(*keys, *_Z, "w", "d2", F.expr(_BUCKET).alias("b"))


def _concentrated(vectors: DataFrame, fits: DataFrame, keys: list[str], p: OutlierParams) -> DataFrame:
    """The fits to the rows that are nearest by the last ones."""
    rows = _measured(vectors, fits, keys)
    nearest = rows.groupBy(*keys).agg(F.percentile("b", p.half, F.col("w")).alias("_most"))
    inside = rows.join(small_or_plain(staged(nearest), 100_000), keys).where("b <= _most")
    return _fitted(_sums(inside, keys), keys, consistency(p.half), p)


def _starts(vectors: DataFrame, p: OutlierParams) -> DataFrame:
    """grp, start and fits: by quartiles, by all rows, and by rows clipped to two spreads around the median."""
    quartiles = [F.percentile(z, [0.25, 0.5, 0.75], F.col("w")).alias(f"_q{z}") for z in _Z]
    middle = staged(vectors.groupBy("grp").agg(*quartiles))
    spread = [f"(_q{z}[2] - _q{z}[0]) / CAST(1.349 AS DOUBLE) + CAST({f * p.unit!r} AS DOUBLE)" for z, f in zip(_Z, p.floors, strict=True)]
    diagonal = [f"({s}) * ({s}) AS v{i}{i}" for i, s in enumerate(spread, 1)]
    zero = [f"CAST(0 AS DOUBLE) AS v{i}{j}" for i, j in _PAIRS if i != j]
    first = _stepped(middle.selectExpr("grp", "0 AS start", *(f"CAST(_q{z}[1] AS DOUBLE) AS m{i}" for i, z in enumerate(_Z, 1)), *diagonal, *zero), cholesky_sql())
    clipped = [f"CAST(floor(least(greatest({z}, _q{z}[1] - 2 * ({s})), _q{z}[1] + 2 * ({s}))) AS BIGINT) AS c{z}" for z, s in zip(_Z, spread, strict=True)]
    near = vectors.join(small_or_plain(middle, 100_000), "grp").selectExpr("grp", "w", *clipped)
    others = _sums(vectors, ["grp"]).withColumn("start", F.lit(1)).unionByName(_sums(near, ["grp"], tuple(f"c{z}" for z in _Z)).withColumn("start", F.lit(2)))
    return staged(first.select("grp", "start", *_FIT).unionByName(_fitted(others, ["grp", "start"], 1.0, p)))


def minimum_covariance(vectors: DataFrame, p: OutlierParams | None = None) -> DataFrame:
    """grp and its robust fit (means m, factor l of the covariance) for weighted vectors (grp, z1 to z4, w)."""
    p = p or OutlierParams()
    fits = _starts(vectors, p)
    for _ in range(p.first_steps):
        fits = _concentrated(vectors, fits, ["grp", "start"], p)
    best = fits.groupBy("grp").agg(F.min(F.struct("size", "start", *_FIT[:-1])).alias("f"))
    fits = staged(best.select("grp", "f.*").select("grp", *_FIT))
    for _ in range(p.more_steps):
        fits = _concentrated(vectors, fits, ["grp"], p)
    inner = _measured(vectors, fits, ["grp"]).where(F.col("d2") <= chi4_quantile(p.inner))
    return _fitted(_sums(inner, ["grp"]), ["grp"], consistency(p.inner), p)


def _pooled(rows: DataFrame, p: OutlierParams) -> DataFrame:
    """lang, source and grp, the group that estimates for them; null where too few rows are left."""
    counts = staged(rows.groupBy("lang", "source").agg(F.count("*").alias("n")))
    by_lang = counts.where(F.col("n") < p.least).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    rest = F.broadcast(by_lang.where(F.col("n_lang") < p.least).agg(F.coalesce(F.sum("n_lang"), F.lit(0)).alias("n_rest")))  # one row
    by_lang = small_or_plain(staged(by_lang), 100_000).withColumnRenamed("lang", "_lang")
    told = counts.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").crossJoin(rest)
    key = lambda *cs: F.concat_ws("", *(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cs))
    grp = F.when(F.col("n") >= p.least, key("lang", "source")).when(F.col("n_lang") >= p.least, key("lang")).when(F.col("n_rest") >= p.least, F.lit(""))
    return staged(told.select("lang", "source", grp.alias("grp")))


def judge(docs: DataFrame, p: OutlierParams | None = None) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, and d2, the squared robust distance of rows that the rules let pass (null: no estimate)."""
    p = p or OutlierParams()
    rows = staged(text_statistics(docs, "doc_id", "lang", "source").withColumn("base_failed", F.expr(failed_sql(p))))
    passed = rows.where("NOT base_failed")
    groups = small_or_plain(_pooled(passed, p).withColumnsRenamed({"lang": "_lang", "source": "_source"}), 100_000)
    at = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    passed = staged(passed.join(groups, at).selectExpr("doc_id", *_BASE, "base_failed", "grp", *transformed_sql(p)))
    vectors = staged(passed.where("grp IS NOT NULL").groupBy("grp", *_Z).agg(F.count("*").alias("w")))
    fits = minimum_covariance(vectors, p)
    told = _stepped(passed.join(small_or_plain(fits, 100_000), "grp", "left"), distance_sql()).select("doc_id", *_BASE, "base_failed", "d2")
    told = told.unionByName(rows.where("base_failed").select("doc_id", *_BASE, "base_failed", F.lit(None).cast("double").alias("d2")))
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= chi4_quantile(1 - p.tail)))
    return told.select("doc_id", *_BASE, "base_failed", kept.alias("kept"), "d2")


def quality_rules(docs: DataFrame, p: OutlierParams | None = None) -> DataFrame:
    return judge(docs, p).drop("d2")


def oracle_sql(p: OutlierParams | None = None) -> str:
    """The rules and the estimates in DuckDB, from rows and not from counted vectors."""
    p = p or OutlierParams()
    space, parts = r"[\x20\x09-\x0D]", []
    parts.append(f"""docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
cut AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM docs),
placed AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS pos FROM cut),
windows AS (SELECT rid, pos, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w AS t FROM placed WINDOW w AS (PARTITION BY rid ORDER BY pos)),
again AS (SELECT rid, pos FROM windows WHERE t IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, t) > 1),
covered AS (SELECT rid, count(DISTINCT pos + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_replace(line, '{space}+', '', 'g') <> '' GROUP BY rid),
base AS (SELECT rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{space}+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM docs JOIN cut USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN covered USING (rid)),
rules AS (SELECT *, {failed_sql(p)} AS base_failed FROM base),
sized AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS n FROM rules WHERE NOT base_failed),
by_lang AS (SELECT *, sum(CASE WHEN n < {p.least} THEN 1 ELSE 0 END) OVER (PARTITION BY lang) AS n_lang FROM sized),
by_all AS (SELECT *, sum(CASE WHEN n < {p.least} AND n_lang < {p.least} THEN 1 ELSE 0 END) OVER () AS n_rest FROM by_lang),
grouped AS (SELECT *, CASE WHEN n >= {p.least} THEN dense_rank() OVER (ORDER BY lang, source) WHEN n_lang >= {p.least} THEN -dense_rank() OVER (ORDER BY lang) WHEN n_rest >= {p.least} THEN 0 END AS grp FROM by_all),
vectors AS (SELECT rid, grp, {", ".join(transformed_sql(p))} FROM grouped WHERE grp IS NOT NULL)""")
    count = 0

    def stepped(source: str, steps: list[list[str]]) -> str:
        nonlocal count
        for step in steps:
            parts.append(f"t{count} AS (SELECT *, {', '.join(step)} FROM {source})")
            source, count = f"t{count}", count + 1
        return source

    def fitted(sums: str, keys: str, factor: float) -> str:
        nonlocal count
        parts.append(f"t{count} AS (SELECT {keys}, {', '.join(covariance_sql(factor, p))} FROM ({sums}))")
        count += 1
        return stepped(f"t{count - 1}", cholesky_sql())

    def concentrated(fits: str, keys: str) -> str:
        nonlocal count
        parts.append(f"t{count} AS MATERIALIZED (SELECT v.*, f.* EXCLUDE (grp) FROM vectors v JOIN {fits} f USING (grp))")
        count += 1
        at = stepped(stepped(f"t{count - 1}", distance_sql()), [[f"{_BUCKET} AS b"]])
        parts.append(f"t{count} AS (SELECT *, quantile_cont(b, {p.half}) OVER (PARTITION BY {keys}) AS most FROM {at})")
        count += 1
        return fitted(f"SELECT {keys}, {', '.join(sums_sql('1'))} FROM t{count - 1} WHERE b <= most GROUP BY {keys}", keys, consistency(p.half))

    quartiles = ", ".join(f"quantile_cont({z}, [0.25, 0.5, 0.75]) AS _q{z}" for z in _Z)
    parts.append(f"middle AS (SELECT grp, {quartiles} FROM vectors GROUP BY grp)")
    spread = [f"(_q{z}[3] - _q{z}[1]) / CAST(1.349 AS DOUBLE) + CAST({f * p.unit!r} AS DOUBLE)" for z, f in zip(_Z, p.floors, strict=True)]
    diagonal = [f"({s}) * ({s}) AS v{i}{i}" for i, s in enumerate(spread, 1)] + [f"CAST(0 AS DOUBLE) AS v{i}{j}" for i, j in _PAIRS if i != j]
    parts.append("first_ AS (SELECT grp, 0 AS start, " + ", ".join(f"CAST(_q{z}[2] AS DOUBLE) AS m{i}" for i, z in enumerate(_Z, 1)) + f", {', '.join(diagonal)} FROM middle)")
    clipped = ", ".join(f"CAST(floor(least(greatest({z}, _q{z}[2] - 2 * ({s})), _q{z}[2] + 2 * ({s}))) AS BIGINT) AS {z}" for z, s in zip(_Z, spread, strict=True))
    sums = lambda rows, start: f"SELECT grp, {start} AS start, {', '.join(sums_sql('1'))} FROM {rows} GROUP BY grp"
    second = fitted(sums("vectors", 1) + " UNION ALL BY NAME " + sums(f"(SELECT grp, {clipped} FROM vectors JOIN middle USING (grp))", 2), "grp, start", 1.0)
    keep = ", ".join(_FIT)
    parts.append(f"f0 AS MATERIALIZED (SELECT grp, start, {keep} FROM {stepped('first_', cholesky_sql())} UNION ALL SELECT grp, start, {keep} FROM {second})")
    at = "f0"
    for k in range(p.first_steps):
        at = concentrated(at, "grp, start")
        parts.append(f"g{k} AS MATERIALIZED (SELECT grp, start, {keep} FROM {at})")
        at = f"g{k}"
    parts.append(f"best AS MATERIALIZED (SELECT grp, {keep} FROM {at} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY size, start) = 1)")
    at = "best"
    for k in range(p.more_steps):
        at = concentrated(at, "grp")
        parts.append(f"h{k} AS MATERIALIZED (SELECT grp, {keep} FROM {at})")
        at = f"h{k}"
    inner = stepped(f"(SELECT v.*, f.* EXCLUDE (grp) FROM vectors v JOIN {at} f USING (grp))", distance_sql())
    final = fitted(f"SELECT grp, {', '.join(sums_sql('1'))} FROM {inner} WHERE d2 <= {chi4_quantile(p.inner)!r} GROUP BY grp", "grp", consistency(p.inner))
    parts.append(f"final_ AS MATERIALIZED (SELECT grp, {keep} FROM {final})")
    told = stepped("(SELECT v.*, f.* EXCLUDE (grp) FROM vectors v JOIN final_ f USING (grp))", distance_sql())
    return "WITH " + ",\n".join(parts) + f"""
SELECT r.doc_id, {", ".join(f"r.{c}" for c in _BASE)}, r.base_failed, NOT r.base_failed AND coalesce(t.d2 <= {chi4_quantile(1 - p.tail)!r}, true) AS kept FROM rules r LEFT JOIN {told} t ON t.rid = r.rid"""
