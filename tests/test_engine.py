import gzip
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from canopy import queries as Q
from canopy.operators import preprocess, voting
from canopy.plans import prequential as P
from canopy.plans.config import EnsembleConfig, HoeffdingConfig, MondrianConfig
from canopy.sources import arff
from canopy.streaming import prequential as S
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(v):
    return "N" if v is None or isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    made = Q.queries()[name](spark, SMALL)
    cursor = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(made.columns)
    wanted = sorted(tuple(same(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(tuple(same(r[c]) for c in sorted(names)) for r in made.collect()) == wanted


def blobs(spark, n=900, flip=None):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] > 0).astype(int)
    if flip:
        y[flip:] = 1 - y[flip:]
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], P.INSTANCE).repartition(5)


GAUSS = HoeffdingConfig("srp", numeric_estimator="gaussian", features_patch=1.0)


@pytest.mark.parametrize("algorithm", [GAUSS, HoeffdingConfig("arf"), MondrianConfig()])
def test_learns(spark, algorithm):
    r = P.prequential(blobs(spark), EnsembleConfig("x", 3, 0, algorithm, "weighted")).toPandas().sort_values("instance_id")
    assert len(r) == 900 and r.is_correct[300:].mean() > 0.75


def test_each_tree_has_a_task_of_its_own(spark):
    told = P.learn(blobs(spark), EnsembleConfig("x", 7, 0, MondrianConfig()), 3, 2).select("tree_id", F.spark_partition_id().alias("part")).distinct().collect()
    assert len(told) == 7 == len({r["part"] for r in told}) == len({r["tree_id"] for r in told})


def test_drift_is_found_and_passed(spark):
    r = P.prequential(blobs(spark, 2400, 1200), EnsembleConfig("x", 3, 0, GAUSS, "soft")).toPandas().sort_values("instance_id")
    assert r.drift_detected[1200:1800].any() and r.is_correct[1900:].mean() > 0.8


def test_unlabelled_and_empty(spark):
    rows = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], None), (2, [1.0], 0)], P.INSTANCE)
    assert P.prequential(rows, EnsembleConfig("x", 2, 0, MondrianConfig())).count() == 3
    assert P.prequential(rows.where("false"), EnsembleConfig("x", 2, 0, GAUSS)).count() == 0


@pytest.mark.parametrize("algorithm", [GAUSS, MondrianConfig()])
def test_stream_equals_batch(spark, tmp_path, algorithm):
    config, got = EnsembleConfig("x", 2, 3, algorithm, "soft"), []
    rows = blobs(spark, 300)
    for k in range(3):
        rows.where(F.col("instance_id").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(P.INSTANCE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = S.learn_stream(stream, config, 3, 2)
    q = S.vote_stream(told, config, 2, lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(got) == sorted(P.prequential(rows, config).collect())


def test_histograms_keep_all_weight(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet").where("user_id IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL")
    wanted = {r[0]: r[1] for r in events.groupBy("user_id").count().collect()}
    made = Q.queries()["histogram_stream"](spark, SMALL).toPandas()
    assert {k: sum(map(sum, w)) for k, w in made.groupby("user_id")["weights"]} == wanted
    assert made.groupby("user_id")["mean"].apply(lambda m: m.is_monotonic_increasing).all() and made["bin"].max() < 16


def test_all_abstain_takes_last_class(spark):
    rows = spark.createDataFrame([(0, 5, [], 1, False, 0.0, None, 0)], P.TREE_RESULT)
    assert voting.combine(rows, "soft", 3).first()["winner"] == 2


def test_run_writes(spark, tmp_path):
    P.run(blobs(spark, 60), EnsembleConfig("a/b_c", 2, 0, MondrianConfig()), str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "master_log_amf")).count() == 1


HEADER = "% c\n@RELATION r\n@ATTRIBUTE 'my attr' numeric\n@attribute c {x,y}\n@attribute cls {n,p}\n\n@DATA\n"


def test_arff(spark, tmp_path):
    body = "1.5,y,p\n?,z,p,\n2,x,n\n1\n{0 7, 2 p}\n% no\n1,x,?\n"
    (tmp_path / "a.arff").write_text(HEADER + body)
    with gzip.open(tmp_path / "b.arff.gz", "wt") as f:
        f.write(HEADER + body)
    for name in ("a.arff", "b.arff.gz"):
        rows = sorted(arff.read_arff(spark, str(tmp_path / name)).collect())
        assert [r["instance_id"] for r in rows] == [0, 1, 2, 3, 4]
        assert [r["features"] for r in rows] == [[1.5, 1.0], [0.0, 0.0], [2.0, 0.0], [7.0, 0.0], [1.0, 0.0]]
        assert [r["label"] for r in rows] == [0, 0, 1, 0, None]
        assert arff.corrupt_rows(spark, str(tmp_path / name)).collect()[0][0] == "1"
    arff.write_arff(arff.read_arff(spark, str(tmp_path / "a.arff")), str(tmp_path / "out"), "r", ["a", "b"], 2)
    again = sorted(arff.read_arff(spark, str(tmp_path / "out")).collect())
    assert [r["features"] for r in again] == [r["features"] for r in rows]


def test_scaling_of_a_constant(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "i int, x double")
    assert [r["x"] for r in preprocess.min_max_scale(rows, ["x"]).orderBy("i").collect()] == [0.5, 0.0, 1.0]


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
