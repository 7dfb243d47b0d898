import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy import queries as Q
from canopy.operators import metrics, scoring
from canopy.operators.trees import MondrianLearner, TreeRunner
from canopy.plans import prequential as P
from canopy.plans.config import EnsembleConfig, HoeffdingConfig, MondrianConfig
from canopy.sources import arff, runs
from tests.conftest import SMALL

GAUSS = HoeffdingConfig("srp", numeric_estimator="gaussian", features_patch=1.0)


def blobs(spark, n=800):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    return [(i, x[i].tolist(), int(x[i, 0] > 0) + int(x[i, 1] > 1)) for i in range(n)]


@pytest.mark.parametrize("algorithm", [GAUSS, MondrianConfig()])
def test_frozen_trees_answer_as_learners_do(spark, algorithm):
    data, config = blobs(spark), EnsembleConfig("x", 3, 5, algorithm)
    rows = spark.createDataFrame(data, P.INSTANCE).repartition(3)
    forest = scoring.fit(rows, config, 3, 3)
    wanted = {}
    for t in range(3):
        runner = TreeRunner(config, t, 3, 3)
        for i, x, y in data:
            runner.step(i, np.array(x), y)
        for i, x, _ in data:
            predicted, votes, depth = runner.learner.predict(np.array(x))
            if isinstance(algorithm, HoeffdingConfig):  # frozen leaves vote by counts
                found = runner.learner.tree._find(np.array(x))[0].counts
                votes = found / found.sum() if found.sum() else np.full(3, 1 / 3)
            v, d = wanted.get(i, (np.zeros(3), 0))
            wanted[i] = v + votes, d + depth / 3
    for small in (100_000, 0):  # as a constant, and by a join
        told = scoring.score_forest(rows, forest, 3, small).collect()
        assert len(told) == len(data)
        for r in told:
            assert r["combined"] == pytest.approx(wanted[r["instance_id"]][0].tolist()) and r["avg_depth"] == pytest.approx(wanted[r["instance_id"]][1])
    assert max(n["depth"] for r in forest.collect() for n in r["nodes"]) > 0


@pytest.mark.parametrize("algorithm", [GAUSS, MondrianConfig()])
def test_trees_in_parts_answer_alike(spark, algorithm):
    """No row holds a tree, and only tops come to the driver."""
    data, config = blobs(spark), EnsembleConfig("x", 3, 5, algorithm)
    data += [(1000, [None, 0.5, 0.1], None), (1001, [0.2], None), (1002, [math.nan, 0.0, 0.0], None)]
    rows = spark.createDataFrame(data, P.INSTANCE).repartition(3)
    learned = rows.where("instance_id < 1000")
    wanted = {r["instance_id"]: r for r in scoring.score_forest(rows, scoring.fit(learned, config, 3, 3), 3).collect()}
    parts = scoring.fit_parts(learned, config, 3, 3, 2 if algorithm is GAUSS else 20)
    sizes = {(r["tree_id"], r["part"]): r["count"] for r in parts.groupBy("tree_id", "part").count().collect()}
    assert len(sizes) > 6 and max(n for (_, part), n in sizes.items() if part) <= 20
    told = scoring.score_parts(rows, parts, 3).collect()
    assert len(told) == len(data) == len(wanted)
    for r in told:
        other = wanted[r["instance_id"]]
        assert r["combined"] == pytest.approx(other["combined"]) and r["avg_depth"] == pytest.approx(other["avg_depth"]) and r["label"] == other["label"]
    assert scoring.score_parts(rows, scoring.fit_parts(learned, config, 3, 3), 3).count() == len(data)


def test_instances_meet_parts_in_packs(spark, monkeypatch):
    """However packed and dealt out, as the learners do; an id that occurs twice had one row with the sum of both."""
    data, config = blobs(spark), EnsembleConfig("x", 2, 5, MondrianConfig())
    learned = spark.createDataFrame(data, P.INSTANCE)
    odd = [(3, [9.0, 0.5, 0.1], 2), (3, [None, 0.5], None), (None, [0.2], None)]
    rows = spark.createDataFrame(data + odd, P.INSTANCE).repartition(3)
    parts = scoring.fit_parts(learned, config, 3, 3, 100).persist()
    runners = [TreeRunner(config, t, 3, 3) for t in range(2)]
    for runner in runners:
        for i, x, y in data:
            runner.step(i, np.array(x), y)
    wanted = {(i, y): sum(r.learner.predict(np.array(x))[1] for r in runners) for i, x, y in [*data, odd[0]]}
    for packed, scored in ((65_536, 2_000_000), (70, 40)):
        monkeypatch.setattr(scoring, "PACKED", packed)
        monkeypatch.setattr(scoring, "SCORED", scored)
        got = scoring.score_parts(rows, parts, 3).collect()
        assert sorted((-1 if r["instance_id"] is None else r["instance_id"], -1 if r["label"] is None else r["label"]) for r in got) == sorted([(i, y) for i, _, y in data] + [(3, 2), (3, -1), (-1, -1)])
        for r in got:
            if (r["instance_id"], r["label"]) in wanted and r["label"] is not None:
                assert r["combined"] == pytest.approx(wanted[r["instance_id"], r["label"]].tolist())
    assert scoring.score_parts(rows.where("false"), parts, 3).count() == 0
    parts.unpersist()


def test_a_mondrian_node_takes_few_bytes():
    """A tree has more nodes than instances; as objects they took more."""
    import tracemalloc

    rng, learner = np.random.default_rng(0), MondrianLearner(MondrianConfig(), 4, 5, 0)
    tracemalloc.start()
    for x, y in zip(rng.random((3000, 4)), rng.integers(0, 5, 3000).tolist(), strict=True):
        learner.predict(x)
        learner.train(x, y, False)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(learner.feature) > 4000 and held / len(learner.feature) < 250


def test_odd_features_go_high(spark):
    rows = spark.createDataFrame([(0, [None], None), (1, [math.nan], 1), (2, [1.0], 0), (3, [], 0), (3, [], 0)], P.INSTANCE)
    tree = [scoring.branch(0, 1.0, 1, 2, 0), scoring.leaf(1, 1), scoring.leaf(2, 1)]
    assert [(r["instance_id"], r["leaf"]) for r in scoring.leaves(rows, [(0, tree)]).orderBy("instance_id").collect()] == [(0, 2), (1, 2), (2, 1), (3, 2), (3, 2)]
    assert scoring.leaves(rows, [(0, [scoring.leaf(0, 0)])]).where("leaf <> 0 OR depth <> 0").count() == 0
    empty = rows.where("false")
    assert scoring.score(empty, scoring.refit(empty, [(0, tree)], 2), 2).count() == 0


def test_scoring_does_not_shuffle(spark):
    rows = spark.createDataFrame(blobs(spark, 20), P.INSTANCE)
    plan = scoring.score(rows, Q._shapes(), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "from_json" not in plan


@pytest.mark.parametrize("algorithm", [GAUSS, HoeffdingConfig("arf"), MondrianConfig()])
@pytest.mark.parametrize("voting", ["soft", "weighted", "majority"])
def test_prequential_equals_plain_loop(spark, algorithm, voting):
    data, config = blobs(spark, 250), EnsembleConfig("x", 3, 1, algorithm, voting)
    trees = [TreeRunner(config, t, 3, 3) for t in range(3)]
    wanted = []
    for i, x, y in data:
        told = [t.step(i, np.array(x), y) for t in trees]
        votes = np.zeros(3)
        for _, _, v, _, _, accuracy, predicted, _ in told:
            if voting == "majority":
                votes[predicted if predicted is not None else []] += 1
            elif len(v):
                votes += np.array(v) * (accuracy if voting == "weighted" else 1)
        winner = max(c for c in range(3) if votes[c] == votes.max())
        close = np.sort(votes)[-1] - np.sort(votes)[-2] < 1e-9  # sums in another order may tell such apart
        wanted.append((i, None if close and votes.any() else winner == y, any(t[4] for t in told)))
    got = {r["instance_id"]: r for r in P.prequential(spark.createDataFrame(data, P.INSTANCE).repartition(4), config).collect()}
    assert len(got) == len(wanted)
    for i, correct, drift in wanted:
        assert got[i]["drift_detected"] == drift and correct in (None, got[i]["is_correct"])


class Window:
    """The adaptive window over all its elements, with the sizes of its buckets from the oldest on."""

    def __init__(self, delta):
        self.delta, self.seen, self.kept, self.sizes = delta, 0, [], []

    def add(self, x):
        self.seen += 1
        self.kept.append(x)
        self.sizes.append(1)
        size = 1
        while self.sizes.count(size) > 5:
            at = self.sizes.index(size)
            self.sizes[at : at + 2] = [2 * size]
            size *= 2
        changed = False
        while self.seen % 32 == 0 and (changed or len(self.kept) > 10) and self.differs():
            self.kept, self.sizes, changed = self.kept[self.sizes[0] :], self.sizes[1:], True
        return changed

    def differs(self):
        n = len(self.kept)
        for cut in np.cumsum(self.sizes):
            a, b = self.kept[:cut], self.kept[cut:]
            if len(a) > 6 and len(b) > 6 and abs(sum(a) / len(a) - sum(b) / len(b)) > math.sqrt((1 / len(a) + 1 / len(b)) * math.log(4 * n * n / self.delta) / 2):
                return True
        return False


def test_adwin_stream_equals_brute_force(spark):
    windows, wanted = {}, {}
    for r in spark.read.parquet(f"{SMALL}/events.parquet").orderBy("event_id").collect():
        w = windows.setdefault(r["event_type"], Window(0.002))
        changed = w.add(0.0 if r["value"] is None or math.isnan(r["value"]) else r["value"])
        wanted[r["event_id"]] = changed, len(w.kept), sum(w.kept) / len(w.kept)
    got = Q.queries()["adwin_stream"](spark, SMALL).collect()
    assert len(got) == len(wanted) and any(c for c, _, _ in wanted.values())
    for r in got:
        assert (r["changed"], r["width"]) == wanted[r["event_id"]][:2] and r["mean"] == pytest.approx(wanted[r["event_id"]][2])


def test_histogram_stream_equals_brute_force(spark):
    bins = {}
    types = list(Q.EVENT_TYPES)
    for r in spark.read.parquet(f"{SMALL}/events.parquet").orderBy("event_id").collect():
        if r["user_id"] is None or r["value"] is None or math.isnan(r["value"]) or r["event_type"] not in types:
            continue
        own = bins.setdefault(r["user_id"], [])
        near = [b for b in own if abs(b[0] - r["value"]) < 1e-9]
        if near:
            near[0][0] = (near[0][0] * sum(near[0][1]) + r["value"]) / (sum(near[0][1]) + 1)
            near[0][1][types.index(r["event_type"])] += 1
            continue
        own.append([r["value"], [float(t == r["event_type"]) for t in types]])
        own.sort(key=lambda b: b[0])
        if len(own) > 16:
            j = min(range(len(own) - 1), key=lambda k: own[k + 1][0] - own[k][0])
            (a, p), (b, q) = own[j], own[j + 1]
            own[j : j + 2] = [[(a * sum(p) + b * sum(q)) / (sum(p) + sum(q)), [u + v for u, v in zip(p, q, strict=True)]]]
    got = {}
    for r in Q.queries()["histogram_stream"](spark, SMALL).orderBy("user_id", "bin").collect():
        got.setdefault(r["user_id"], []).append((r["mean"], r["weights"]))
    assert got.keys() == bins.keys()
    for user, own in bins.items():
        assert [m for m, _ in got[user]] == pytest.approx([b[0] for b in own]) and [w for _, w in got[user]] == [b[1] for b in own]


def test_running_accuracy_over_small_blocks(spark):
    rng = np.random.default_rng(0)
    right = rng.random(300) < 0.6
    rows = spark.createDataFrame([(7 * i, bool(right[i]), False, 0.0) for i in range(300)], "instance_id long, is_correct boolean, drift_detected boolean, avg_depth double").repartition(3)
    summed = metrics.running_sums(rows, "instance_id", {"n": F.lit(1).cast("long"), "s": F.col("is_correct").cast("long")}, block=16).orderBy("instance_id").collect()
    assert [(r["n"], r["s"]) for r in summed] == [(i + 1, int(right[: i + 1].sum())) for i in range(300)]
    for block in (1, 64, 1000):
        told = metrics.prequential_accuracy(rows, 50, block).orderBy("instance_id").collect()
        assert [r["prequential_accuracy"] for r in told] == [None if i < 49 else pytest.approx(right[i - 49 : i + 1].mean()) for i in range(300)]


def test_run_from_config_to_tables(spark, tmp_path):
    rng = np.random.default_rng(1)
    lines = ["@relation r", "@attribute a numeric", "@attribute b {x,y}", "@attribute c {n,p}", "@data", *(f"{v:.4f},{'xy'[i % 2]},{'np'[int(v > 0)]}" for i, v in enumerate(rng.normal(size=80)))]
    (tmp_path / "d.arff").write_text("\n".join(lines))
    out = str(tmp_path / "out")
    for k, algorithm in enumerate(({"type": "srp", "lambda": 4, "features_patch": 0.6, "numeric_estimator": "gaussian"}, {"type": "amf"})):
        (tmp_path / f"c{k}.json").write_text(json.dumps({"dataset": "d", "n_trees": 2, "seed": 0, "voting": "soft", "algorithm": algorithm}))
        P.execute(spark, str(tmp_path / f"c{k}.json"), str(tmp_path), out)
    ht = runs.read_log(spark, out, "ht").collect()
    assert len(ht) == 1 and ht[0]["lambda"] == 4 and ht[0]["features_patch"] == 1.0 and ht[0]["n_instances"] == 80 and ht[0]["ensemble_type"] == "srp"
    amf = runs.runs_with_final_accuracy(spark, out, "amf").collect()
    assert len(amf) == 1 and amf[0]["dirichlet"] is None and 0.5 < amf[0]["final_accuracy"] <= 1
    assert {r["id"]: r["count"] for r in runs.read_results(spark, out).groupBy("id").count().collect()} == {ht[0]["id"]: 80, amf[0]["id"]: 80}
    scaled = runs.scalability(spark, out, "amf").collect()
    assert len(scaled) == 1 and scaled[0]["speedup"] == 1
    P.run_seeds(arff.read_arff(spark, str(tmp_path / "d.arff")), P.read_config(spark, str(tmp_path / "c1.json")), [1, 2], out)
    assert sorted(r["seed"] for r in runs.read_benchmark(spark, out).collect()) == [1, 2]


def test_arff_keeps_missing_null(spark, tmp_path):
    (tmp_path / "a.arff").write_text("@relation r\n@attribute a numeric\n@attribute b {x,y}\n@attribute c {n,p}\n@data\n?,y,p\n2,?,n\nbad,z,?\n")
    rows = arff.read_arff(spark, str(tmp_path / "a.arff"), missing="null").orderBy("instance_id").collect()
    assert [r["features"] for r in rows] == [[None, 1.0], [2.0, None], [None, None]] and [r["label"] for r in rows] == [0, 1, None]
    with pytest.raises(ValueError, match="missing"):
        arff.read_arff(spark, str(tmp_path / "a.arff"), missing="x")


def test_arff_keeps_rows_that_begin_with_at(spark, tmp_path):
    head = "% c\n@relation r\n@attribute a {@x,y}\n@attribute b numeric\n@attribute c {n,p}\n"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.arff").write_text(head + "@DATA\n@x,1,p\n\n% no\n\t@data,2,n\r\n@x,3,p\n@attribute z numeric\n")
    (tmp_path / "d" / "2.arff").write_text("@relation other\n" + head + "y,4,n\n@x,5,n\n{0 @x, 2 p}\n")
    rows = [tuple(r) for r in arff.read_arff(spark, str(tmp_path / "d")).orderBy("instance_id").collect()]
    assert rows == [(0, [0.0, 1.0], 0, "p"), (1, [0.0, 2.0], 1, "n"), (2, [0.0, 3.0], 0, "p"), (3, [1.0, 4.0], 1, "n"), (4, [0.0, 5.0], 1, "n"), (5, [0.0, 0.0], 0, "p")]
    assert [r[0] for r in arff.corrupt_rows(spark, str(tmp_path / "d")).collect()] == ["@attribute z numeric"]


def test_arff_ids_are_dense_over_blocks(spark, tmp_path):
    lines = ["@relation r", "@attribute a numeric", "@attribute c {n,p}", "@data", *(f"{i},{'np'[i % 2]}" if i % 5 else "% x" for i in range(4000))]
    (tmp_path / "a.arff").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = arff.read_arff(spark, str(tmp_path / "a.arff"))
        assert rows.rdd.getNumPartitions() > 1
        got = sorted((r["instance_id"], r["features"][0]) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(k, float(i)) for k, i in enumerate(i for i in range(4000) if i % 5)]
