from datetime import datetime, timedelta

import numpy as np
import pytest

from canopy.operators import voting
from canopy.plans import prequential as P
from canopy.plans.config import EnsembleConfig, HoeffdingConfig
from canopy.streaming import votes

CONFIG = EnsembleConfig("x", 3, 0, HoeffdingConfig("srp"), "weighted")


def tree_rows(n=40, trees=(0, 1, 2)):
    rng = np.random.default_rng(0)
    return [(t, i, [float(v) for v in rng.integers(0, 8, 3)], i % 3 if i % 7 else None, bool((i + t) % 19 == 0), float(t + 1) / 4, int(rng.integers(0, 3)), int(t + i % 4)) for i in range(n) for t in trees]


def write(spark, rows, path):
    spark.createDataFrame(rows, P.TREE_RESULT).coalesce(1).write.mode("append").parquet(str(path))


def start(spark, path, sink, checkpoint, patience=600_000):
    stream = spark.readStream.schema(P.TREE_RESULT).option("maxFilesPerTrigger", 1).parquet(str(path))
    told = votes.collect_votes(stream, CONFIG, 3, patience, span=8)
    return told.writeStream.foreachBatch(sink).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()


def wanted(spark, rows):
    done = voting.combine(spark.createDataFrame(rows, P.TREE_RESULT), "weighted", 3, 3).collect()
    return {r["instance_id"]: (r["label"], r["winner"], pytest.approx(r["combined"]), r["drift_detected"], pytest.approx(r["avg_depth"])) for r in done}


def told(rows):
    return {r["instance_id"]: (r["label"], r["winner"], r["combined"], r["drift_detected"], r["avg_depth"]) for r in rows}


def test_trees_of_an_instance_may_come_in_different_batches(spark, tmp_path):
    rows = tree_rows()
    for k in range(3):  # each file has another tree of each third of the instances
        write(spark, [r for r in rows if (r[0] + r[1]) % 3 == k], tmp_path / "in")
    batches = []
    start(spark, tmp_path / "in", lambda df, _: batches.append(df.collect()), tmp_path / "ck").awaitTermination(180)
    out = [r for b in batches for r in b]
    assert [len(b) for b in batches if b] == [40] and all(r["complete"] and r["n_trees"] == 3 for r in out)
    assert told(out) == wanted(spark, rows)


def test_incomplete_instances_are_told_after_a_while(spark, tmp_path):
    rows = tree_rows(20)
    write(spark, [r for r in rows if r[0] < 2 or r[1] % 2], tmp_path / "in")
    write(spark, tree_rows(24)[60:], tmp_path / "in")
    out = []
    start(spark, tmp_path / "in", lambda df, _: out.extend(df.collect()), tmp_path / "ck", patience=0).awaitTermination(180)
    late = [r for r in out if not r["complete"]]
    assert {r["instance_id"] for r in out if r["complete"]} == {*range(1, 20, 2), *range(20, 24)}
    assert {r["instance_id"] for r in late} == set(range(0, 20, 2)) and {r["n_trees"] for r in late} == {2}


def test_a_restart_neither_loses_nor_doubles(spark, tmp_path):
    rows = tree_rows(30)
    for k in range(2):
        write(spark, [r for r in rows if (r[0] + r[1] // 10) % 2 == k], tmp_path / "in")
    sink = votes.table_sink(str(tmp_path / "out"))

    def fails_after_writing(df, batch_id):
        sink(df, batch_id)
        if batch_id == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        start(spark, tmp_path / "in", fails_after_writing, tmp_path / "ck").awaitTermination(180)
    start(spark, tmp_path / "in", sink, tmp_path / "ck").awaitTermination(180)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 30 and told(out) == wanted(spark, rows)


def test_labels_may_come_late(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    predictions = [(i, t0 + timedelta(minutes=i), i % 2) for i in range(60)]
    labels = [(i, t0 + timedelta(minutes=i + 3), 1) for i in range(0, 40)] + [(i, t0 + timedelta(hours=9), 1) for i in range(40, 50)]
    for name, rows, schema in (("p", predictions, "instance_id long, at timestamp, winner int"), ("l", labels, "instance_id long, labelled_at timestamp, label int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        end = (10**6, t0 + timedelta(days=2), 0)
        spark.createDataFrame([end], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda n, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    joined = votes.with_late_labels(read("p", "instance_id long, at timestamp, winner int"), read("l", "instance_id long, labelled_at timestamp, label int"), "20 minutes")
    out = []
    joined.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(180)
    got = {r["instance_id"]: r["correct"] for r in out if r["instance_id"] < 60}
    assert got == {i: (bool(i % 2) if i < 40 else None) for i in range(60)}
    assert len(out) == len({r["instance_id"] for r in out})
