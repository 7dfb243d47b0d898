"""The registered queries of the ensemble engine over the given tables, with DuckDB SQL for those that SQL can express.

Pseudo-trees vote by a linear congruence that both engines compute alike; sums are of whole numbers where order could matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.functions import draws
from canopy.functions import exprs as X
from canopy.operators import histograms, metrics, mondrian_levels, preprocess, scoring, voting, windows
from canopy.plans import blocks
from canopy.plans import prequential as P
from canopy.plans.config import EnsembleConfig, HoeffdingConfig, MondrianConfig
from canopy.sources.scratch import staged
from canopy.sources.tables import EVENT_TYPES, event_instances, table

#: Thresholds of the Poisson(6) distribution's cumulative shares, to 0.9999 and over.
POISSON_6 = (0.0024787522, 0.0173512652, 0.0619688044, 0.1512038828, 0.2850565003, 0.4456796414, 0.6063027824, 0.7439797604, 0.8472374939, 0.9160759829, 0.9573790764, 0.9799082183, 0.9911727893, 0.9963718220, 0.9985999789, 0.9994912417)
N_TREES, SEED = 10, 7
_LABEL = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(EVENT_TYPES)) + " END"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c: Column | str) -> Column:
    return F.round(c, 6)


def _label() -> Column:
    return F.expr(_LABEL)


_U = "((event_id * CAST(1103515245 AS BIGINT) + tree_id * CAST(12345 AS BIGINT) + {s}) % 2147483648)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of TREE_RESULT from pseudo-trees with whole votes 0 to 7, accuracies in eighths and depths."""
    base = _events(spark, sf_dir).select("event_id", _label().cast("int").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(N_TREES - 1))).alias("tree_id"))
    u = lambda s: F.expr(_U.format(s=s))
    votes = F.array(*(((F.floor(u(c * 7919) / 65536) % 8).cast("double")) for c in range(5)))
    return base.select("tree_id", F.col("event_id").alias("instance_id"), votes.alias("votes"), "label", (F.floor(u(31) / 65536) % 50 == 0).alias("drift"), ((F.floor(u(41) / 65536) % 9).cast("double") / 8).alias("accuracy"), X.argmax_last(votes).alias("predicted"), (F.floor(u(51) / 65536) % 7).cast("int").alias("depth"))


def _us(s: int) -> str:
    return f"CAST(floor({_U.format(s=s)} / 65536) AS BIGINT)"


_TREES = f"""base AS (SELECT event_id, {_LABEL} AS label, tree_id FROM events, (SELECT unnest(range({N_TREES})) AS tree_id) t),
rows_ AS (SELECT tree_id, event_id AS instance_id, label, {", ".join(f"CAST({_us(c * 7919)} % 8 AS DOUBLE) AS v{c}" for c in range(5))},
  {_us(31)} % 50 = 0 AS drift, CAST({_us(41)} % 9 AS DOUBLE) / 8 AS accuracy, {_us(51)} % 7 AS depth FROM base),
told AS (SELECT *, CASE greatest(v0,v1,v2,v3,v4) WHEN v4 THEN 4 WHEN v3 THEN 3 WHEN v2 THEN 2 WHEN v1 THEN 1 ELSE 0 END AS predicted FROM rows_)"""


def _vote_sql(ballot: Callable[[int], str]) -> str:
    return f"""WITH {_TREES}, s AS (SELECT instance_id, any_value(label) AS label, bool_or(drift) AS drift_detected, avg(depth) AS avg_depth, {", ".join(f"sum({ballot(c)}) AS s{c}" for c in range(5))} FROM told GROUP BY 1),
w AS (SELECT *, CASE greatest(s0,s1,s2,s3,s4) WHEN s4 THEN 4 WHEN s3 THEN 3 WHEN s2 THEN 2 WHEN s1 THEN 1 ELSE 0 END AS winner FROM s)
SELECT instance_id, winner IS NOT DISTINCT FROM label AS is_correct, drift_detected, round(avg_depth, 6) AS avg_depth FROM w"""


def _voted(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    return voting.results(voting.combine(_tree_rows(spark, sf_dir), how, 5, N_TREES)).withColumn("avg_depth", _r("avg_depth"))


@query(f"SELECT tree_id, count(*) AS n FROM events, (SELECT CAST(unnest(range({N_TREES})) AS INTEGER) AS tree_id) t GROUP BY 1")
def fan_out_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fan_out(event_instances(spark, sf_dir), N_TREES).groupBy("tree_id").agg(F.count("*").alias("n"))


@query("SELECT event_type AS label, CAST(row_number() OVER (ORDER BY f, event_type) - 1 AS INTEGER) AS label_id FROM (SELECT event_type, min(event_id) AS f FROM events WHERE event_type IS NOT NULL GROUP BY 1)")
def label_dictionary_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.label_dictionary(_events(spark, sf_dir), "event_type", "event_id")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 1.0::DOUBLE WHEN 'click' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS code, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, 0.0::DOUBLE AS unread FROM events")
def ordinal_and_number_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", preprocess.ordinal(F.col("event_type"), ["error", "view", "click"]).alias("code"), preprocess.number_or_zero(F.get_json_object("props", "$.k")).alias("k"), preprocess.number_or_zero(F.col("event_type")).alias("unread"))


@query("SELECT event_id, round((coalesce(value, 0) - lo) / (hi - lo), 6) AS value FROM events, (SELECT min(coalesce(value, 0)) AS lo, max(coalesce(value, 0)) AS hi FROM events) m")
def min_max_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.min_max_scale(_events(spark, sf_dir).select("event_id", "value"), ["value"]).withColumn("value", _r("value"))


@query("SELECT event_id, " + ", ".join(f"CAST(coalesce(event_type = '{t}', false) AS DOUBLE) AS \"event_type#{t}\"" for t in EVENT_TYPES) + " FROM events")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.one_hot(_events(spark, sf_dir).select("event_id", "event_type"), "event_type", list(EVENT_TYPES))


@query("SELECT l_returnflag AS value, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL)")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.label_encode(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query(_vote_sql(lambda c: f"v{c}"))
def soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir, "soft")


@query(_vote_sql(lambda c: f"v{c} * accuracy"))
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir, "weighted")


@query(_vote_sql(lambda c: f"CAST(predicted = {c} AS DOUBLE)"))
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir, "majority")


@query(f"WITH {_TREES} SELECT tree_id, instance_id, " + ", ".join(f"round(CASE WHEN v0+v1+v2+v3+v4 > 0 THEN v{c}/(v0+v1+v2+v3+v4) ELSE 0.2 END, 6) AS p{c}" for c in range(5)) + " FROM told")
def scores_to_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tree_rows(spark, sf_dir).select("tree_id", F.col("instance_id"), X.scores_to_votes(F.col("votes"), 5).alias("p"))
    return rows.select(F.col("tree_id").cast("long").alias("tree_id"), "instance_id", *(_r(F.element_at("p", c + 1)).alias(f"p{c}") for c in range(5)))


@query("SELECT user_id, event_id, round(CASE WHEN t > 0 THEN e / t ELSE 1.0 / n END, 6) AS share FROM (SELECT user_id, event_id, e, sum(e) OVER (PARTITION BY user_id) AS t, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, event_id, CAST(event_id % 5 AS DOUBLE) AS e FROM events))")
def normalize_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_id", (F.col("event_id") % 5).cast("double").alias("e"))
    return voting.normalize(rows, "user_id", "e").select("user_id", "event_id", _r("share").alias("share"))


def _bagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.fan_out(event_instances(spark, sf_dir), N_TREES)
    u = X.pseudo_random((F.col("instance_id"), 1103515245), (F.col("tree_id"), 12345), (F.lit(1), SEED))
    return rows.withColumn("k", X.poisson_from_uniform(u, POISSON_6))


_K = " + ".join(f"CAST(u >= CAST({t} AS DOUBLE) AS INT)" for t in POISSON_6)


@query(f"SELECT tree_id, label, sum(k)::BIGINT AS weight, count(*) FILTER (k = 0) AS unseen FROM (SELECT tree_id, {_LABEL} AS label, {_K} AS k FROM (SELECT *, {_U.format(s=SEED)} / CAST(2147483648.0 AS DOUBLE) AS u FROM events, (SELECT CAST(unnest(range({N_TREES})) AS INTEGER) AS tree_id) t)) GROUP BY 1, 2")
def poisson_bagging_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bagged(spark, sf_dir).groupBy("tree_id", "label").agg(F.sum("k").cast("long").alias("weight"), F.count(F.when(F.col("k") == 0, 1)).alias("unseen"))


_ENT = "CASE WHEN n > 0 AND total > 0 THEN -(n/total) * log2(n/total) ELSE 0 END"


@query(f"SELECT user_id, round(sum({_ENT}), 6) AS entropy FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY user_id) AS total FROM events GROUP BY user_id, event_type) GROUP BY 1")
def class_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy("user_id")))
    return n.groupBy("user_id").agg(_r(F.sum(X.entropy_terms(F.col("n"), F.col("total")))).alias("entropy"))


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, mean, m2, low and high of two whole-valued features of lineitem for each return flag."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", F.explode(F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("price"), F.floor("l_extendedprice").cast("double"))).alias("feature", "x"))
    w = F.col("l_linenumber").cast("double")
    sums = rows.groupBy("feature", F.col("l_returnflag").alias("cls")).agg(F.sum(w).alias("weight"), F.sum(w * F.col("x")).alias("s1"), F.sum(w * F.col("x") * F.col("x")).alias("s2"), F.min("x").alias("low"), F.max("x").alias("high"))
    return sums.select("feature", "cls", "weight", (F.col("s1") / F.col("weight")).alias("mean"), (F.col("s2") - F.col("s1") * F.col("s1") / F.col("weight")).alias("m2"), "low", "high")


_MOMENTS = """raw AS (SELECT 'quantity' AS feature, l_returnflag AS cls, CAST(l_linenumber AS DOUBLE) AS w, l_quantity AS x FROM lineitem UNION ALL SELECT 'price', l_returnflag, CAST(l_linenumber AS DOUBLE), floor(l_extendedprice) FROM lineitem),
sums AS (SELECT feature, cls, sum(w) AS weight, sum(w*x) AS s1, sum(w*x*x) AS s2, min(x) AS low, max(x) AS high FROM raw GROUP BY 1, 2),
stats AS (SELECT feature, cls, weight, s1/weight AS mean, s2 - s1*s1/weight AS m2, low, high FROM sums)"""


@query(f"WITH {_MOMENTS} SELECT feature, cls, weight, round(mean, 4) AS mean, round(CASE WHEN weight > 1 THEN sqrt(m2/(weight-1)) ELSE 0 END, 4) AS deviation, low, high FROM stats")
def gaussian_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(spark, sf_dir).select("feature", "cls", "weight", F.round("mean", 4).alias("mean"), F.round(X.deviation(F.col("weight"), F.col("m2")), 4).alias("deviation"), "low", "high")


_ERF_T = "(1 / (1 + 0.3275911 * abs(z)))"
_ERF = f"(sign(z) * (1 - exp(-z*z) * ({_ERF_T} * (0.254829592 + {_ERF_T} * (-0.284496736 + {_ERF_T} * (1.421413741 + {_ERF_T} * (-1.453152027 + {_ERF_T} * 1.061405429)))))))"
_GAINS = f"""{_MOMENTS}, ends AS (SELECT feature, min(low) AS lo, max(high) AS hi FROM stats GROUP BY 1),
points AS (SELECT feature, i, lo + (hi - lo) / 11 * (i + 1) AS point FROM ends, (SELECT unnest(range(10)) AS i) t),
zs AS (SELECT p.feature, i, point, cls, weight, (point - mean) / (sqrt(m2/(weight-1)) * sqrt(2.0::DOUBLE)) AS z FROM points p JOIN stats s ON p.feature = s.feature),
sides AS (SELECT feature, i, point, weight, weight * (1 + {_ERF}) / 2 AS l FROM zs),
tot AS (SELECT *, weight - l AS r, sum(weight) OVER w AS n, sum(l) OVER w AS nl, sum(weight - l) OVER w AS nr FROM sides WINDOW w AS (PARTITION BY feature, i)),
gains AS (SELECT feature, i, point, max(n) AS n, sum({_ENT.replace('n/total', 'weight/n').replace('n > 0 AND total > 0', 'weight > 0')}) - max(nl)/max(n) * sum(CASE WHEN l > 0 THEN -(l/nl)*log2(l/nl) ELSE 0 END) - max(nr)/max(n) * sum(CASE WHEN r > 0 THEN -(r/nr)*log2(r/nr) ELSE 0 END) AS gain FROM tot GROUP BY 1, 2, 3)"""


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _moments(spark, sf_dir)
    ends = stats.groupBy("feature").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    points = ends.select("feature", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"), "lo", "hi").select("feature", "i", X.split_point(F.col("lo"), F.col("hi"), F.col("i"), 10).alias("point"))
    left = F.col("weight") * X.gaussian_below(F.col("point"), F.col("weight"), F.col("mean"), F.col("m2"))
    rows = points.join(stats, "feature").select("feature", "i", "point", "weight", left.alias("l"))
    w = Window.partitionBy("feature", "i")
    rows = rows.withColumn("r", F.col("weight") - F.col("l")).withColumns({"n": F.sum("weight").over(w), "nl": F.sum("l").over(w), "nr": F.sum("r").over(w)})
    ent = lambda a, b: F.sum(X.entropy_terms(F.col(a), F.col(b)))
    n, nl, nr = (F.max(c) for c in ("n", "nl", "nr"))
    return rows.groupBy("feature", "i", "point").agg(n.alias("n"), (ent("weight", "n") - nl / n * ent("l", "nl") - nr / n * ent("r", "nr")).alias("gain"))


@query(f"WITH {_GAINS} SELECT feature, CAST(i AS INTEGER) AS i, round(point, 4) AS point, round(gain, 5) AS gain FROM gains")
def info_gain_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gains(spark, sf_dir).select("feature", "i", F.round("point", 4).alias("point"), F.round("gain", 5).alias("gain"))


@query(f"WITH {_GAINS} SELECT feature, CAST(i AS INTEGER) AS i, round(point, 4) AS point, round(gain, 5) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(gain, 8) DESC, i) AS place FROM gains) WHERE place = 1")
def best_split_per_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate threshold of largest gain for each feature, the lowest of equals."""
    best = F.max(F.struct(F.round("gain", 8).alias("rounded"), (-F.col("i")).alias("first"), "i", "point", "gain")).alias("b")
    return _gains(spark, sf_dir).groupBy("feature").agg(best).select("feature", "b.i", F.round("b.point", 4).alias("point"), F.round("b.gain", 5).alias("gain"))


@query(f"WITH {_GAINS}, best AS (SELECT feature, max(n) AS n, max(gain) AS gain FROM gains GROUP BY 1), b AS (SELECT max(gain) AS first, coalesce(list_sort(list(gain), 'DESC')[2], 0) AS second, max(n) AS n FROM best) SELECT round(first - second, 5) AS lead, round(sqrt(ln(1/0.01::DOUBLE)/(2*n)), 6) AS bound, first - second > sqrt(ln(1/0.01::DOUBLE)/(2*n)) OR sqrt(ln(1/0.01::DOUBLE)/(2*n)) < 0.05 AS splits FROM b")
def hoeffding_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _gains(spark, sf_dir).groupBy("feature").agg(F.max("n").alias("n"), F.max("gain").alias("gain"))
    bound, lead = X.hoeffding_bound(F.lit(0.01), F.col("n")), F.col("first") - F.col("second")
    gains = F.sort_array(F.collect_list("gain"), asc=False)  # one for each feature
    return best.agg(F.max("gain").alias("first"), F.coalesce(F.try_element_at(gains, F.lit(2)), F.lit(0.0)).alias("second"), F.max("n").alias("n")).select(F.round(lead, 5).alias("lead"), _r(bound).alias("bound"), ((lead > bound) | (bound < 0.05)).alias("splits"))


@query(f"WITH {_MOMENTS}, q AS (SELECT cls, mean, m2/(weight-1) AS v, weight FROM stats WHERE feature = 'quantity'), x AS (SELECT DISTINCT l_quantity AS x FROM lineitem), s AS (SELECT x, cls, weight * exp(-(x-mean)*(x-mean)/(2*v)) / (sqrt(v)*sqrt(2*pi())) AS score FROM x, q) SELECT x, cls, round(score / sum(score) OVER (PARTITION BY x), 6) AS vote FROM s")
def naive_bayes_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _moments(spark, sf_dir).where("feature = 'quantity'").select("cls", "weight", "mean", "m2")
    xs = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x")).distinct()
    # The statistics have one row a class.
    rows = xs.join(F.broadcast(stats)).withColumn("score", F.col("weight") * X.gaussian_pdf(F.col("x"), F.col("weight"), F.col("mean"), F.col("m2")))
    return rows.select("x", "cls", _r(F.col("score") / F.sum("score").over(Window.partitionBy("x"))).alias("vote"))


@query("SELECT cls, bin, n, CAST(sum(n) OVER (PARTITION BY cls ORDER BY bin) AS BIGINT) AS n_left FROM (SELECT l_returnflag AS cls, CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def equiwidth_bins_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("cls"), F.floor(F.col("l_quantity") / 5).alias("bin")).agg(F.count("*").alias("n"))
    return bins.withColumn("n_left", F.sum("n").over(Window.partitionBy("cls").orderBy("bin")))


_RES = f"res AS ({_vote_sql(lambda c: f'v{c}')})"


@query(f"WITH {_RES} SELECT instance_id, is_correct, row_number() OVER o AS row_number, CAST(sum(CAST(is_correct AS BIGINT)) OVER o AS BIGINT) AS cumulative_correct, round(avg(CAST(is_correct AS DOUBLE)) OVER o, 6) AS cumulative_accuracy FROM res WINDOW o AS (ORDER BY instance_id ROWS UNBOUNDED PRECEDING)")
def cumulative_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cumulative_accuracy(soft_vote(spark, sf_dir)).select("instance_id", "is_correct", "row_number", "cumulative_correct", _r("cumulative_accuracy").alias("cumulative_accuracy"))


@query(f"WITH {_RES} SELECT instance_id, CASE WHEN row_number() OVER (ORDER BY instance_id) >= 500 THEN round(CAST(sum(CAST(is_correct AS BIGINT)) OVER (ORDER BY instance_id ROWS 499 PRECEDING) AS DOUBLE) / 500, 6) END AS prequential_accuracy FROM res")
def prequential_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.prequential_accuracy(soft_vote(spark, sf_dir), 500).select("instance_id", _r("prequential_accuracy").alias("prequential_accuracy"))


@query(f"WITH {_RES} SELECT instance_id, row_number FROM (SELECT instance_id, row_number() OVER (ORDER BY instance_id) AS row_number FROM res) WHERE (row_number - 1) % 25 = 0")
def sampled_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sampled(metrics.cumulative_accuracy(soft_vote(spark, sf_dir)), 25).select("instance_id", "row_number")


@query(f"WITH {_RES}, e AS (SELECT *, CAST(coalesce(sum(CAST(drift_detected AS BIGINT)) OVER (ORDER BY instance_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS epoch FROM res) SELECT instance_id, epoch, round(avg(CAST(is_correct AS DOUBLE)) OVER (PARTITION BY epoch ORDER BY instance_id ROWS UNBOUNDED PRECEDING), 6) AS epoch_accuracy FROM e")
def drift_epoch_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.drift_epochs(soft_vote(spark, sf_dir)).select("instance_id", "epoch", _r("epoch_accuracy").alias("epoch_accuracy"))


@query(f"WITH {_RES}, c AS (SELECT instance_id, CAST(row_number() OVER o AS DOUBLE) AS n0, CAST(sum(CAST(is_correct AS BIGINT)) OVER o AS DOUBLE) AS s0 FROM res WINDOW o AS (ORDER BY instance_id ROWS UNBOUNDED PRECEDING)), t AS (SELECT *, max(n0) OVER () AS n, max(s0) OVER () AS s FROM c) SELECT instance_id, round(abs(s0/n0 - (s-s0)/(n-n0)), 6) AS gap, round(sqrt((1/n0 + 1/(n-n0)) * ln(4*n*n/0.01::DOUBLE) / 2), 6) AS bound FROM t WHERE n0 > 6 AND n - n0 > 6")
def adwin_single_cut_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.cumulative_accuracy(soft_vote(spark, sf_dir)).select("instance_id", F.col("row_number").cast("double").alias("n0"), F.col("cumulative_correct").cast("double").alias("s0"))
    c = c.crossJoin(F.broadcast(c.agg(F.max("n0").alias("n"), F.max("s0").alias("s"))))  # one row
    n1 = F.col("n") - F.col("n0")
    return c.where((F.col("n0") > 6) & (n1 > 6)).select("instance_id", _r(F.abs(F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1)).alias("gap"), _r(X.adwin_bound(F.col("n0"), n1, F.lit(0.01))).alias("bound"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of runs made of customers: id, dataset, threads, throughput, accuracy."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("dataset"), F.col("c_nationkey").alias("n_threads"), F.col("c_acctbal").alias("throughput"), ((F.col("c_custkey") * 7919) % 1000 / 1000.0).cast("double").alias("accuracy"))


_RUNS = "runs AS (SELECT c_custkey AS id, c_mktsegment AS dataset, c_nationkey AS n_threads, c_acctbal AS throughput, CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 1000 AS accuracy FROM customer)"


@query(f"WITH {_RUNS} SELECT id, dataset, accuracy FROM (SELECT *, max(accuracy) OVER (PARTITION BY dataset ORDER BY throughput, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM runs) WHERE b IS NULL OR accuracy > b")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pareto_frontier(_runs(spark, sf_dir), "dataset").select("id", "dataset", "accuracy")


@query("WITH t AS (SELECT c_nationkey + 1 AS n_threads, CAST(count(*) AS DOUBLE) AS throughput FROM customer GROUP BY 1), b AS (SELECT *, first_value(throughput) OVER (ORDER BY n_threads) AS bt, first_value(n_threads) OVER (ORDER BY n_threads) AS bn FROM t) SELECT n_threads, throughput, round(throughput/bt, 6) AS speedup, round(throughput/bt / (CAST(n_threads AS DOUBLE)/bn) * 100, 6) AS efficiency FROM b")
def speedup_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") + 1).alias("n_threads")).agg(F.count("*").cast("double").alias("throughput"))
    return metrics.speedup(runs).select("n_threads", "throughput", _r("speedup").alias("speedup"), _r("efficiency").alias("efficiency"))


@query(f"WITH {_RUNS} SELECT id, dataset, n_threads FROM runs WHERE (dataset, n_threads) IN (SELECT (dataset, n_threads) FROM runs ORDER BY id DESC LIMIT 1)")
def latest_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest_config(_runs(spark, sf_dir), ["dataset", "n_threads"]).select("id", "dataset", "n_threads")


@query(f"WITH {_RUNS} SELECT dataset, round(quantile_cont(accuracy, 0.85), 6) AS q85 FROM runs GROUP BY 1")
def accuracy_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).groupBy("dataset").agg(_r(F.percentile("accuracy", F.lit(0.85))).alias("q85"))


@query(f"WITH {_RUNS} SELECT r.id, r.throughput, a.final_accuracy FROM runs r JOIN (SELECT o_custkey AS id, round(avg(CAST(o_orderstatus = 'F' AS DOUBLE)), 6) AS final_accuracy FROM orders GROUP BY 1) a ON r.id = a.id")
def runs_with_final_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(_r(F.avg((F.col("o_orderstatus") == "F").cast("double"))).alias("final_accuracy"))
    return _runs(spark, sf_dir).join(final, "id").select("id", "throughput", "final_accuracy")


@query("""WITH x AS (SELECT vec_id, label, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS i) t),
b AS (SELECT label, i, min(v) AS low, max(v) AS high FROM x WHERE vec_id % 2 = 0 GROUP BY ALL)
SELECT vec_id, label, round(sum(greatest(low - v, v - high, 0)), 6) AS extension FROM x JOIN b USING (label, i) GROUP BY vec_id, label""")
def mondrian_box_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each vector lies outside the box of its label's even-numbered vectors, over all components."""
    v = _vectors(spark, sf_dir)
    at = lambda i: F.get("features", F.lit(i))
    box = v.where("instance_id % 2 = 0").groupBy("label").agg(*(f(at(i)).alias(f"{n}{i}") for n, f in (("l", F.min), ("h", F.max)) for i in range(64)))
    parts = [X.box_extension(at(i), F.col(f"l{i}"), F.col(f"h{i}")) for i in range(64)]
    return v.join(box, "label").select(F.col("instance_id").alias("vec_id"), "label", _r(sum(parts[1:], parts[0])).alias("extension"))


@query(f"SELECT user_id, label, round((n + 0.01) / (sum(n) OVER (PARTITION BY user_id) + 0.05), 6) AS p FROM (SELECT user_id, {_LABEL} AS label, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2)")
def mondrian_leaf_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _events(spark, sf_dir).groupBy("user_id", _label().alias("label")).agg(F.count("*").cast("double").alias("n"))
    return n.select("user_id", "label", _r(X.leaf_probability(F.col("n"), F.sum("n").over(Window.partitionBy("user_id")), F.lit(0.01), F.lit(5))).alias("p"))


@query("SELECT event_id, CASE WHEN value <= 50 THEN CASE WHEN user_id <= 100 THEN 3 ELSE 4 END ELSE 2 END AS leaf, CASE WHEN value <= 50 THEN 2 ELSE 1 END AS depth FROM events")
def frozen_tree_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = [scoring.branch(0, 50, 1, 2, 0), scoring.branch(1, 100, 3, 4, 1), scoring.leaf(2, 1), scoring.leaf(3, 2), scoring.leaf(4, 2)]
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("instance_id"), F.array("value", F.col("user_id").cast("double")).alias("features"), F.lit(None).cast("int").alias("label"))
    return scoring.leaves(rows, [(0, tree)]).select(F.col("instance_id").alias("event_id"), "leaf", "depth")


def _shapes() -> list[tuple]:
    """Three trees that split values at 20, 50 and 80, the upper part by user at 100 and the lower one by hour at 12."""
    b, lf = scoring.branch, scoring.leaf
    return [(t, [b(0, 20.0 + 30 * t, 1, 2, 0), b(2, 12.0, 3, 4, 1), b(1, 100.0, 5, 6, 1), *(lf(i, 2) for i in range(3, 7))]) for t in range(3)]


_LEAF = "CASE WHEN coalesce(value, 0) <= 20 + 30 * tree_id THEN CASE WHEN coalesce(hour(ts), 0) <= 12 THEN 3 ELSE 4 END ELSE CASE WHEN coalesce(user_id, 0) <= 100 THEN 5 ELSE 6 END END"


@query(f"""WITH at_ AS (SELECT event_id, {_LABEL} AS label, tree_id, {_LEAF} AS leaf FROM events, (SELECT unnest(range(3)) AS tree_id) t),
votes AS (SELECT tree_id, leaf, {", ".join(f"CAST(count(*) FILTER (label = {c}) AS DOUBLE) / count(*) AS v{c}" for c in range(5))} FROM at_ WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT event_id, {", ".join(f"round(sum(coalesce(v{c}, 0.2)), 6) AS v{c}" for c in range(5))}, 2.0::DOUBLE AS avg_depth FROM at_ LEFT JOIN votes USING (tree_id, leaf) GROUP BY 1""")
def refitted_forest_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen forest whose leaves take their votes from all events, and its soft votes for each."""
    rows = event_instances(spark, sf_dir)
    told = scoring.score(rows, scoring.refit(rows, _shapes(), len(EVENT_TYPES)), len(EVENT_TYPES))
    return told.select(F.col("instance_id").alias("event_id"), *(_r(F.get("combined", F.lit(c))).alias(f"v{c}") for c in range(5)), "avg_depth")


@query()
def mondrian_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mondrian trees learned from all events, then frozen and asked about each event: their tops by column expressions, the parts below where rows meet them."""
    rows, config = event_instances(spark, sf_dir), EnsembleConfig("events", 3, 0, MondrianConfig(), "soft")
    told = scoring.score_parts(rows, staged(scoring.fit_parts(rows, config, 4, len(EVENT_TYPES))), len(EVENT_TYPES))
    return told.select("instance_id", "winner", *(_r(F.get("combined", F.lit(c))).alias(f"v{c}") for c in range(5)), "avg_depth")


@query("SELECT l_orderkey, l_partkey, l_suppkey, round(greatest(a, b) + ln((1 + exp(least(a, b) - greatest(a, b))) / 2), 6) AS log_weight FROM (SELECT *, -l_quantity / 10 AS a, -l_discount * 20 AS b FROM lineitem)")
def mondrian_log_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", _r(X.log_mean_exp(-F.col("l_quantity") / 10, -F.col("l_discount") * 20)).alias("log_weight"))


def _prequential(kind: str) -> Query:
    algorithm = MondrianConfig() if kind == "amf" else HoeffdingConfig(kind, numeric_estimator="gaussian")
    config = EnsembleConfig("events", 3 if kind == "amf" else 10, 0, algorithm, "soft" if kind == "amf" else "weighted")
    return lambda spark, sf_dir: P.prequential(event_instances(spark, sf_dir), config)


for _kind in ("srp", "arf", "amf"):
    QUERIES[f"{_kind}_prequential"] = _prequential(_kind)


@query()
def adwin_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drifts of each type's values: one window a key, fed in order of id."""
    import pandas as pd

    from canopy.operators.estimators import Adwin

    def run(parts):  # noqa: ANN001, ANN202
        open_key, window = None, None
        for part in parts:
            rows = []
            for i, key, x in zip(part["event_id"], part["event_type"], part["value"], strict=True):
                if key != open_key:
                    open_key, window = key, Adwin(0.002)
                changed = window.add(float(x) if x == x else 0.0)
                rows.append((i, key, changed, window.width, window.mean))
            yield pd.DataFrame(rows, columns=["event_id", "event_type", "changed", "width", "mean"])

    rows = _events(spark, sf_dir).select("event_id", "event_type", "value").repartition("event_type").sortWithinPartitions("event_type", "event_id")
    return rows.mapInPandas(run, "event_id long, event_type string, changed boolean, width long, mean double")


@query()
def histogram_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive histograms of each user's values by event type, fed in order of id: a row for each bin that is left.

    Rows without a value or a known type are not learned.
    """
    import pandas as pd

    from canopy.operators.estimators import Histogram

    def run(parts):  # noqa: ANN001, ANN202
        open_key, histogram, made = None, None, []

        def close() -> None:
            if histogram is not None:
                made.extend(zip([open_key] * len(histogram.means), range(len(histogram.means)), histogram.means.tolist(), histogram.by_class.tolist(), strict=True))

        def frame() -> pd.DataFrame:
            return pd.DataFrame(made, columns=["user_id", "bin", "mean", "weights"])

        for part in parts:
            for key, x, label in zip(part["user_id"].tolist(), part["value"].tolist(), part["label"].tolist(), strict=True):
                if key != open_key:
                    close()
                    open_key, histogram = key, Histogram(len(EVENT_TYPES), 16)
                    if len(made) >= 10_000:
                        yield frame()
                        made.clear()
                histogram.update(x, label, 1.0)
        close()
        yield frame()

    rows = _events(spark, sf_dir).select("user_id", "event_id", "value", _label().cast("int").alias("label")).where("user_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND label IS NOT NULL")
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", "event_id")
    return rows.mapInPandas(run, "user_id long, bin int, mean double, weights array<double>")


#: Ends of 20 blocks of 32 ticks, whatever the ids are.
_ENDS = list(range(32, 641, 32))
_TICK = "(event_id - lo) * 640 {div} (hi - lo + 1)"
_OVER_50 = "CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS DOUBLE)"
_TICKS = f"SELECT event_type, {_TICK.format(div='//')} AS tick, count(*) AS n, {_OVER_50} AS s FROM events, (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events) e WHERE event_type IS NOT NULL GROUP BY 1, 2"


@query(f"SELECT * REPLACE (round(mean, 6) AS mean) FROM ({windows.oracle_sql(_TICKS, 'event_type', 0.002, _ENDS)})")
def adaptive_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over how often each type's values exceed 50, tested after each of 20 blocks; no type's events meet in one task."""
    events = _events(spark, sf_dir)
    ends = events.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    rows = events.where("event_type IS NOT NULL").crossJoin(F.broadcast(ends))  # one row
    ticks = rows.groupBy("event_type", F.expr(_TICK.format(div="div")).alias("tick")).agg(F.count("*").alias("n"), F.expr(_OVER_50).alias("s"))
    return windows.adaptive_windows(ticks, ["event_type"], 0.002, _ENDS).withColumn("mean", _r("mean"))


_HIST = histograms.HistogramParams(bins=32)
_FLAG = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END"
_HIST_CTE = histograms.oracle_cte(f"SELECT l_linestatus, l_extendedprice AS x, {_FLAG} AS label, CAST(1 AS DOUBLE) AS w FROM lineitem", "l_linestatus", _HIST)


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_linestatus", "l_extendedprice", F.expr(_FLAG).alias("flag"))


@query(f"WITH {_HIST_CTE} SELECT l_linestatus, CAST(bin AS INTEGER) AS bin, min(x) AS low, max(x) AS high, round(sum(x) / sum(w), 4) AS mean, {', '.join(f'CAST(count(*) FILTER (label = {c}) AS DOUBLE) AS w{c}' for c in range(3))} FROM bins GROUP BY l_linestatus, bin")
def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of about equal weight of the prices of each line status, with weights by return flag."""
    rows = histograms.histograms(_priced(spark, sf_dir), ["l_linestatus"], "l_extendedprice", "flag", 3, _HIST)
    return rows.select("l_linestatus", "bin", "low", "high", F.round("mean", 4).alias("mean"), *(F.get("weights", F.lit(c)).alias(f"w{c}") for c in range(3)))


@query(f"""WITH {_HIST_CTE}, edges AS (SELECT l_linestatus, bin, (max(x) + lead(min(x)) OVER (PARTITION BY l_linestatus ORDER BY bin)) / 2 AS point FROM bins GROUP BY l_linestatus, bin),
counts AS (SELECT l_linestatus, bin, label, CAST(count(*) AS DOUBLE) AS n FROM bins GROUP BY ALL),
sides AS (SELECT e.l_linestatus, e.bin, e.point, b.label, sum(CASE WHEN b.bin <= e.bin THEN n ELSE 0 END) AS l, sum(CASE WHEN b.bin > e.bin THEN n ELSE 0 END) AS r FROM edges e JOIN counts b USING (l_linestatus) WHERE point IS NOT NULL GROUP BY ALL),
tot AS (SELECT *, sum(l) OVER o AS nl, sum(r) OVER o AS nr, sum(l + r) OVER o AS n FROM sides WINDOW o AS (PARTITION BY l_linestatus, bin)),
ents AS (SELECT l_linestatus, bin, max(point) AS point, sum(-(l + r) / n * log2((l + r) / n)) AS h, max(nl) / max(n) * sum(CASE WHEN l > 0 THEN -l / nl * log2(l / nl) ELSE 0 END) AS hl, max(nr) / max(n) * sum(CASE WHEN r > 0 THEN -r / nr * log2(r / nr) ELSE 0 END) AS hr FROM tot GROUP BY 1, 2)
SELECT l_linestatus, bin, round(point, 4) AS point, round(h - hl - hr, 6) AS gain FROM ents""")
def histogram_split_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a split of the prices after each bin would tell about the return flag."""
    keys = ["l_linestatus"]
    bins = histograms.binned(histograms.cells(_priced(spark, sf_dir), keys, "l_extendedprice", "flag", F.lit(1.0), _HIST), keys, _HIST)
    return histograms.split_gains(bins, keys).select("l_linestatus", F.col("bin").cast("long").alias("bin"), F.round("point", 4).alias("point"), _r("gain").alias("gain"))


_U5 = draws.uniform_sql("event_id", "tree_id", 5)
_INSIDE = [f"{draws.subset_sql(5, 3, 'event_id', 9, str(i))} AS has{i}" for i in range(5)]


@query(f"SELECT event_id, tree_id, round(u, 9) AS u, {draws.poisson_sql('u', 6.0)} AS k, round(-ln(1.0 - u) / 2.0, 6) AS wait, least(CAST(u * 6 >= 1 AS INT) + CAST(u * 6 >= 3 AS INT) + CAST(u * 6 >= 6 AS INT), 2) AS place, {', '.join(_INSIDE)} FROM (SELECT event_id, tree_id, {_U5} AS u FROM events, (SELECT CAST(unnest(range(3)) AS INTEGER) AS tree_id) t)")
def counter_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of each event and tree: uniform, Poisson, exponential, one of three weighted places, and three of five numbers for the event."""
    rows = _events(spark, sf_dir).select("event_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("tree_id")).withColumn("u", draws.uniform_column("event_id", "tree_id", 5))
    u, weights = F.col("u"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    told = [F.round("u", 9).alias("u"), F.expr(draws.poisson_sql("u", 6.0)).alias("k"), _r(draws.exponential(u, F.lit(2.0))).alias("wait"), draws.discrete(u, weights).alias("place")]
    return rows.select("event_id", "tree_id", *told, *map(F.expr, _INSIDE))


def _block_config(kind: str) -> EnsembleConfig:
    """Random patches split their roots after one block of these labels; the adaptive forest asks for more, so its roots vote by naive Bayes."""
    strict = {"delta": 1e-7, "tau": 1e-4} if kind == "arf" else {}
    return EnsembleConfig("events", 10, 0, HoeffdingConfig(kind, drift_detection=False, numeric_estimator="gaussian", **strict), "soft")


def _block(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Trees learned from the first half of the events as one block; both halves are predicted before they are learned."""
        rows = event_instances(spark, sf_dir)
        low, high = rows.agg(F.min("instance_id"), F.max("instance_id")).first()
        ends = [] if low is None else [(low, low + (high - low + 1) // 2), (low + (high - low + 1) // 2, high + 1)]
        return blocks.prequential_blocks(rows, _block_config(kind), ends=ends).withColumn("avg_depth", _r("avg_depth"))

    return run


def _block_sql(kind: str) -> str:
    c = _block_config(kind)
    a, shares = c.algorithm, lambda side: f"CASE WHEN list_sum({side}) > 0 THEN [x / list_sum({side}) FOR x IN {side}] ELSE [0.2, 0.2, 0.2, 0.2, 0.2] END"
    term = lambda x, n: f"CASE WHEN {x} > 0 THEN -({x}) / ({n}) * log2(({x}) / ({n})) ELSE 0 END"
    t = "(1 / (1 + 0.3275911 * abs(z)))"
    erf = f"(sign(z) * (1 - exp(-z*z) * ({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))))))"
    return f"""WITH inst AS (SELECT event_id AS id, [coalesce(CAST(value AS DOUBLE), 0), coalesce(CAST(user_id AS DOUBLE), 0), coalesce(CAST(hour(ts) AS DOUBLE), 0), coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)] AS f, {_LABEL} AS label FROM events),
half AS (SELECT min(id) + (max(id) - min(id) + 1) // 2 AS mid FROM inst), slots AS (SELECT CAST(unnest(range({c.n_trees})) AS BIGINT) AS slot),
bag AS (SELECT id, slot, f, label, {draws.poisson_sql('u', a.lambda_)} AS k FROM (SELECT id, slot, f, label, {draws.uniform_sql('id', 'slot', c.seed + 7)} AS u FROM inst, half, slots WHERE id < mid AND label IS NOT NULL)),
own AS (SELECT slot, feature FROM slots, (SELECT CAST(unnest(range(4)) AS BIGINT) AS feature) x WHERE {draws.subset_sql(4, a.subspace_size(4), 'slot * 1000003', c.seed + 101, 'feature')}),
vals AS (SELECT slot, feature, label AS cls, CAST(k AS DOUBLE) AS k, f[feature + 1] AS x FROM bag JOIN own USING (slot) WHERE k > 0),
sums AS (SELECT slot, feature, cls, sum(k) AS n, sum(k * x) / sum(k) AS mean, sum(k * x * x) - sum(k * x) * sum(k * x) / sum(k) AS m2, min(x) AS lo, max(x) AS hi FROM vals GROUP BY ALL),
stats AS (SELECT *, CASE WHEN n > 1 THEN sqrt(greatest(m2, 0) / (n - 1)) ELSE 0 END AS dev FROM sums),
points AS (SELECT slot, feature, i, lo + (hi - lo) / 11 * (i + 1) AS point FROM (SELECT slot, feature, min(lo) AS lo, max(hi) AS hi FROM stats GROUP BY ALL), (SELECT unnest(range(10)) AS i) t),
zs AS (SELECT slot, feature, i, point, cls, n, dev, mean, CASE WHEN dev >= 1e-10 THEN (point - mean) / (dev * sqrt(2.0::DOUBLE)) ELSE 1 END AS z FROM points JOIN stats USING (slot, feature)),
cut AS (SELECT slot, feature, i, point, cls, n, n * CASE WHEN dev < 1e-10 THEN CAST(point >= mean AS INT) ELSE (1 + {erf}) / 2 END AS l FROM zs),
sides AS (SELECT *, greatest(n - l, 0) AS r, sum(n) OVER o AS an, sum(l) OVER o AS al, sum(greatest(n - l, 0)) OVER o AS ar FROM cut WINDOW o AS (PARTITION BY slot, feature, i)),
gains AS (SELECT slot, feature, i, point, max(an) AS n, sum({term('n', 'an')}) AS own_entropy, sum({term('n', 'an')}) - max(al) / max(an) * sum({term('l', 'al')}) - max(ar) / max(an) * sum({term('r', 'ar')}) AS gain,
  map(list(cls), list(l)) AS ls, map(list(cls), list(r)) AS rs FROM sides WHERE al >= 1 AND ar >= 1 GROUP BY ALL HAVING own_entropy > 1e-12),
by_feature AS (SELECT * REPLACE (round(gain, 9) AS gain) FROM gains QUALIFY row_number() OVER (PARTITION BY slot, feature ORDER BY round(gain, 9) DESC, i) = 1),
ranked AS (SELECT *, lead(gain) OVER (PARTITION BY slot ORDER BY gain DESC, feature) AS second, row_number() OVER (PARTITION BY slot ORDER BY gain DESC, feature) AS place FROM by_feature),
split AS (SELECT slot, feature, point, [coalesce(ls[c], 0) FOR c IN range(5)] AS low, [coalesce(rs[c], 0) FOR c IN range(5)] AS high FROM ranked WHERE place = 1 AND (gain - coalesce(second, '-inf'::DOUBLE) > sqrt(ln(1 / {a.delta}::DOUBLE) / (2 * n)) OR sqrt(ln(1 / {a.delta}::DOUBLE) / (2 * n)) < {a.tau})),
later AS (SELECT id, f, label, slot FROM inst, half, slots WHERE id >= mid),
classes AS (SELECT slot, cls, max(n) AS n FROM stats GROUP BY ALL), total AS (SELECT slot, sum(n) AS n FROM classes GROUP BY slot),
density AS (SELECT l.id, l.slot, s.cls, product(CASE WHEN s.n <= 1 THEN 0 WHEN dev < 1e-10 THEN CAST(l.f[feature + 1] = mean AS INT) ELSE exp(-(l.f[feature + 1] - mean) * (l.f[feature + 1] - mean) / (2 * dev * dev)) / (dev * sqrt(2 * pi())) END) AS p FROM later l JOIN stats s USING (slot) WHERE slot NOT IN (SELECT slot FROM split) GROUP BY ALL),
scores AS (SELECT d.id, d.slot, map(list(d.cls), list(c.n / t.n * d.p)) AS m FROM density d JOIN classes c USING (slot, cls) JOIN total t USING (slot) GROUP BY ALL),
naive AS (SELECT id, slot, [coalesce(m[c], 0) FOR c IN range(5)] AS v FROM scores),
told AS (SELECT l.id, l.slot, CASE WHEN s.slot IS NULL THEN {shares('n.v')} WHEN l.f[s.feature + 1] <= s.point THEN {shares('s.low')} ELSE {shares('s.high')} END AS v, CASE WHEN s.slot IS NULL THEN 0 ELSE 1 END AS depth
  FROM later l LEFT JOIN split s USING (slot) LEFT JOIN naive n ON n.id = l.id AND n.slot = l.slot),
votes AS (SELECT id, {', '.join(f'sum(v[{k + 1}]) AS v{k}' for k in range(5))}, avg(depth) AS d FROM told GROUP BY id),
won AS (SELECT id, CASE greatest(v0, v1, v2, v3, v4) WHEN v4 THEN 4 WHEN v3 THEN 3 WHEN v2 THEN 2 WHEN v1 THEN 1 ELSE 0 END AS winner, d FROM votes)
SELECT id AS instance_id, label IS NOT DISTINCT FROM coalesce(winner, 4) AS is_correct, false AS drift_detected, round(coalesce(d, 0), 6) AS avg_depth FROM inst LEFT JOIN won USING (id)"""


def _blocks(kind: str) -> Query:
    """The whole run in blocks that double, with drift detection."""
    config = EnsembleConfig("events", 10, 0, HoeffdingConfig(kind, numeric_estimator="gaussian"), "weighted")
    return lambda spark, sf_dir: blocks.prequential_blocks(event_instances(spark, sf_dir), config)


for _kind in ("srp", "arf"):
    QUERIES[f"{_kind}_block"], SQL[f"{_kind}_block"], QUERIES[f"{_kind}_blocks"] = _block(_kind), _block_sql(_kind), _blocks(_kind)


_MONDRIAN, _LEVELS, _DEEP = MondrianConfig(split_pure=True), mondrian_levels.LevelParams(max_depth=4), mondrian_levels.LevelParams(max_depth=7)
_VECTORS = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, label FROM embeddings"
_VECTOR_CTE = mondrian_levels.oracle_cte(f"{_VECTORS} WHERE vec_id % 2 = 0", _MONDRIAN, 3, 64, 10, SEED, _LEVELS)


def _walk_sql(source: str, n_trees: int, depth: int, n_classes: int, key: str) -> str:
    """Votes for every row of a source by the trees of `oracle_cte`."""
    walk = [f"q0 AS (SELECT id, f, CAST(tree_id AS BIGINT) AS tree_id, CAST(1 AS BIGINT) AS node FROM ({source}) s, (SELECT unnest(range({n_trees})) AS tree_id) t)"]
    walk += [f"q{d + 1} AS (SELECT id, f, q.tree_id, CASE WHEN s.node IS NULL THEN q.node WHEN f[s.feature + 1] <= s.threshold THEN q.node * 2 ELSE q.node * 2 + 1 END AS node FROM q{d} q LEFT JOIN (SELECT * FROM n{d} WHERE feature IS NOT NULL) s ON s.tree_id = q.tree_id AND s.node = q.node)" for d in range(depth)]
    votes = ", ".join(f"round(sum(v.votes[{c + 1}]), 6) AS v{c}" for c in range(n_classes))
    return f"{', '.join(walk)} SELECT q.id AS {key}, {votes}, round(avg(v.depth), 6) AS avg_depth FROM q{depth} q JOIN forest v ON v.tree_id = q.tree_id AND v.node = q.node GROUP BY q.id"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("instance_id"), "embedding", "label").select("instance_id", F.col("embedding").cast("array<double>").alias("features"), "label")


def _level_votes(told: DataFrame, key: str, n_classes: int) -> DataFrame:
    return told.select(F.col("instance_id").alias(key), *(_r(F.get("combined", F.lit(c))).alias(f"v{c}") for c in range(n_classes)), _r("avg_depth").alias("avg_depth"))


@query(f"WITH {_VECTOR_CTE} SELECT tree_id, node, CAST(depth AS INTEGER) AS depth, n, CAST(feature AS INTEGER) AS feature, round(threshold, 6) AS threshold, round(split_time, 6) AS split_time, round(weight, 6) AS weight, round(log_weight, 6) AS log_weight FROM forest")
def mondrian_level_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of three Mondrian trees drawn level by level from the even-numbered vectors, with boxes over all their components."""
    nodes = mondrian_levels.grow(_vectors(spark, sf_dir).where("instance_id % 2 = 0"), _MONDRIAN, 3, 64, 10, SEED, _LEVELS)
    return nodes.select(F.col("tree_id").cast("long").alias("tree_id"), "node", "depth", "n", "feature", *(_r(c).alias(c) for c in ("threshold", "split_time", "weight", "log_weight")))


@query(f"WITH {_VECTOR_CTE}, {_walk_sql(_VECTORS, 3, 4, 10, 'vec_id')}")
def mondrian_level_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft votes of those trees for every vector."""
    rows = _vectors(spark, sf_dir)
    trees = mondrian_levels.fit(rows.where("instance_id % 2 = 0"), _MONDRIAN, 3, 64, 10, SEED, _LEVELS)
    return _level_votes(scoring.score_forest(mondrian_levels.clean(rows, 64), trees, 10), "vec_id", 10)


_EVENT_ROWS = f"SELECT event_id AS id, [coalesce(CAST(value AS DOUBLE), 0), coalesce(CAST(user_id AS DOUBLE), 0), coalesce(CAST(hour(ts) AS DOUBLE), 0), coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)] AS f, {_LABEL} AS label FROM events"


@query(f"WITH {mondrian_levels.oracle_cte(_EVENT_ROWS, MondrianConfig(), 5, 4, 5, SEED, _DEEP)}, {_walk_sql(_EVENT_ROWS, 5, 7, 5, 'event_id')}")
def mondrian_level_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five trees of seven levels from all events, whose pure nodes stay leaves, and their soft votes for each event."""
    rows = event_instances(spark, sf_dir)
    trees = mondrian_levels.fit(rows, MondrianConfig(), 5, 4, len(EVENT_TYPES), SEED, _DEEP)
    return _level_votes(scoring.score_forest(mondrian_levels.clean(rows, 4), trees, len(EVENT_TYPES)), "event_id", len(EVENT_TYPES))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
