import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import merkle, outliers, queries, whitening
from canopy.llm.common import table
from tests.conftest import SMALL

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, tree string, pos int, n int, w double, grp string, d2 double, digest string"
EXTRA = (1, "x", 2, 3, 0.5, "g", 9.0, "h")
LONG = "And the cat\nsat on the old mat with a dog | " * 4000


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCUMENT)


ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "!!! 123", None, "a", 7), (None, "The cat", "en", "a", None), (5, LONG, "en", "a", len(LONG)), (6, "the cat Sat", "en", "b", 11), (6, "the cat Sat", "en", "b", 11), (7, "dër\nHund\x0bÜ 🙂", "de", "ü", 9), (10, "ABC", None, None, 3), (14, "É", "", "", 1)]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """The manifest from its words: rows of (doc_id, text, lang, source, n_chars)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha(*map(part, (r[0], r[3], r[2], r[4], t)))

    def climb(nodes):
        """The last node, and each one's siblings by level as (left, right)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for k, i in enumerate(at):
                own, slot = runs[i // 16], i % 16
                paths[k].append(("".join(own[:slot]), "".join(own[slot + 1 :])))
                at[k] = i // 16
            nodes = [sha(*r) for r in runs]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    subs, found = [], []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        sub, paths = climb([leaf(r, r[1]) for r in own])
        subs.append(sub)
        found += [(r, len(subs) - 1, path) for r, path in zip(own, paths, strict=True)]
    root, above = climb(subs) if subs else (None, [])
    out = []
    for r, k, path in found:
        path = path + above[k]
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        text = r[1] if r[1] is None or not tampered else re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
        folded = leaf(r, text)
        for left, right in path:
            folded = sha(left, folded, right)
        out.append((r[0], leaf(r, r[1]), subs[k], root, sha(*(x for s in path for x in s)), folded, folded == root))
    return sorted(out, key=str)


def test_manifest_by_plain_hashing(spark):
    docs = table(spark, SMALL, "documents")
    want = plain_manifest([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert sorted(map(tuple, merkle.check_manifest(docs).collect()), key=str) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 3


@pytest.mark.parametrize("rows", [ODD, ODD[:1], ODD[5:7], []])
def test_manifest_of_odd_rows(spark, rows):
    assert sorted(map(tuple, merkle.check_manifest(frame(spark, rows)).collect()), key=str) == plain_manifest(rows)


def test_manifest_of_many_levels_and_sources(spark):
    rows = [(i, f"Text {i}", "en", "hot" if i % 3 else f"s{i % 57}", 5) for i in range(700)] + [(9, "x", "en", "hot", 1)] * 40
    docs = frame(spark, rows).repartition(7)
    assert sorted(map(tuple, merkle.check_manifest(docs).collect()), key=str) == plain_manifest(rows)


def test_manifest_finds_a_changed_text(spark):
    told = merkle.manifest(frame(spark, ODD)).collect()
    assert {len(r["path"]) for r in told} == {1, 2} and len({r["root"] for r in told}) == 1
    changed = merkle.manifest(frame(spark, [*ODD[:-1], (14, "E", "", "", 1)])).first()
    assert changed["root"] != told[0]["root"]


def plain_statistics(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    threes = Counter(zip(words, words[1:], words[2:]))
    covered = {p + d for p in range(len(words) - 2) if threes[tuple(words[p : p + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_of_texts(spark):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate([*(r[1] for r in ODD), "a b", "a b c a b c", "a a a a", "x\n\nx\n \n \nx y\r\n", "#*$%&|<>", "🙂🙂 é\x0bb\x0cc\x85d e", " a\n a\na"])]
    got = {r["doc_id"]: tuple(r)[1:] for r in outliers.text_statistics(frame(spark, rows), "doc_id").collect()}
    assert got == {r[0]: plain_statistics(r[1]) for r in rows}


def test_outliers_match_sql_and_labels(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    query = queries.queries()["op12_outliers"]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "kept")) for r in query(spark, "/root/testdata/sf0.01").collect()}
    want = con.execute(f"SELECT doc_id, n_words, kept FROM ({outliers.oracle_sql()})").fetchall()
    assert got == {i: (n, k) for i, n, k in want}
    quality = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    told = {q: [got[i] for i in quality if quality[i] == q and got[i][0] >= 50] for q in (0, 1)}
    assert np.mean([k for _, k in told[1]]) > 0.9 and not any(k for _, k in told[0] if _ >= 300)


def vectors(spark, groups):
    rows = [(g, *map(int, z), 1) for g, zs in groups.items() for z in zs]
    return spark.createDataFrame(rows, "grp string, z1 long, z2 long, z3 long, z4 long, w long")


def test_minimum_covariance_against_plain_search(spark):
    """A third of far rows moves neither mean nor covariance, and no plain search finds a half with a smaller determinant by much."""
    rng, p = np.random.default_rng(3), outliers.OutlierParams(floors=(0.01,) * 4)
    mix = rng.normal(size=(4, 4)) * 60
    clean = np.rint(rng.normal(size=(400, 4)) @ mix.T + 1500).astype(int)
    far = np.rint(rng.normal(size=(190, 4)) * 20 + 3000).astype(int)
    fits = {r["grp"]: r for r in outliers.minimum_covariance(vectors(spark, {"a": np.vstack([clean, far]), "b": clean, "one": np.tile([5, 6, 7, 8], (60, 1))}), p).collect()}

    def shape(r):
        low = np.array([[r[f"l{i}{j}"] if j <= i else 0 for j in range(1, 5)] for i in range(1, 5)])
        return np.array([r[f"m{i}"] for i in range(1, 5)]), low @ low.T

    want = np.cov(clean.T, bias=True)
    for grp in "ab":
        mean, cov = shape(fits[grp])
        d = clean - mean
        distance = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        assert np.abs(mean - clean.mean(axis=0)).max() < 25 and (distance > 33).sum() == 0
        assert abs(np.log(np.linalg.det(cov) / np.linalg.det(want))) < 0.6
        out = far - mean
        assert (np.einsum("ij,jk,ik->i", out, np.linalg.inv(cov), out) > 33).all()
    assert shape(fits["one"])[0].tolist() == [5, 6, 7, 8]


def test_outliers_do_not_depend_on_partitions_or_copies_beside(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("lang = 'en'")
    one, many = ({r["doc_id"]: r["d2"] for r in outliers.judge(docs.repartition(k)).collect()} for k in (1, 9))
    assert one == many


@pytest.mark.parametrize("rows", [ODD, []])
def test_outliers_of_odd_rows(spark, rows):
    got = outliers.judge(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["base_failed"], r["kept"], r["d2"]) for r in got) == sorted((str(r[0]), plain_statistics(r[1])[0], True, False, None) for r in rows)


def test_small_groups_are_pooled(spark):
    text = lambda i: " ".join(f"{'abcdefgh'[(i * 7 + k) % 8] * (2 + (i + k * k) % 6)}{k}" for k in range(60))
    rows = [(i, text(i), "en", f"s{i % 40}", 0) for i in range(120)] + [(1000 + i, text(i), None, None, 0) for i in range(3)] + [(2000, "### " * 59 + text(1), "en", "s1", 0)]
    rows += [(3000 + i, text(i), "fr", "s", 0) for i in range(3)]
    got = {r["doc_id"]: r for r in outliers.judge(frame(spark, rows)).collect()}
    assert got[5]["d2"] is not None and got[5]["kept"] and got[1000]["d2"] is None and got[1000]["kept"] and got[3000]["d2"] is None
    assert got[2000]["base_failed"] or not got[2000]["kept"]
    assert sum(r["kept"] for r in got.values()) == len(rows) - 1
    assert all(r["d2"] is None and r["kept"] for r in outliers.judge(frame(spark, rows[:30])).collect())


def test_chi_squared():
    assert outliers.chi4_quantile(0.5) == pytest.approx(3.356694, abs=1e-6) and outliers.chi4_quantile(0.975) == pytest.approx(11.143287, abs=1e-6)
    x = np.random.default_rng(0).normal(size=(200_000, 4))
    d = (x * x).sum(axis=1)
    inner = x[d <= outliers.chi4_quantile(0.5)]
    assert outliers.consistency(0.5) * inner.var() == pytest.approx(1, abs=0.02)


def plain_whitening(x, k):
    n, s = len(x), x.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return (x - s / n) @ u / np.sqrt(e), e


def whitened(df, p=None):
    out = whitening.whiten(df, p).toPandas()
    return out, np.stack(out["whitened"]) if len(out) else None


def test_whitening_against_numpy(spark):
    df = table(spark, SMALL, "embeddings")
    got = whitening.whitened_components(df).toPandas()
    src = df.toPandas().set_index("vec_id")
    x = np.floor(64 * np.stack(src["embedding"]).astype(float)).astype(np.int64) + 1_000_000
    z, e = plain_whitening(x, 32)
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[src.index].to_numpy()
    assert np.abs(w - z * np.sign((w * z).sum(axis=0))).max() < 1e-8
    n, first = len(x), got[got["component"] == 1].set_index("vec_id").loc[src.index]
    assert (first["deviation"].to_numpy() == ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)).all() and set(got["n"]) == {n}
    assert sorted(got["component"].unique()) == list(range(1, 33)) and got["identity_error"].max() < 1e-9
    shares = got.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert shares == pytest.approx(e / np.trace(np.cov(x.T, bias=True)), rel=1e-9)


def test_copies_weigh_and_are_answered_each(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 5)).astype(np.float32)
    rows = np.vstack([base, np.tile(base[3], (200, 1))])
    df = spark.createDataFrame([(i % 250, [float(v) for v in r], 1) for i, r in enumerate(rows)], "vec_id long, embedding array<float>, k1 int")
    out, w = whitened(df)
    z, _ = plain_whitening(np.floor(64 * rows.astype(float)).astype(np.int64) + 1_000_000, 5)
    order = out["vec_id"].argsort(kind="stable")
    assert len(out) == 260 and set(out["n"]) == {260} and out["identity_error"].max() < 1e-9
    key = lambda a: sorted(map(tuple, np.round(np.abs(a), 6)))
    assert key(w[order]) == key(z)
    alone, _ = whitened(df, whitening.WhiteningParams(multiplicity=False))
    assert set(alone["n"]) == {60} and len(alone) == 260


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, `a.b` int, whitened string, weight int"
    good = [[1.0, 2.0], [1.5, -2.0], [-1.0, 0.25], [3.0, 3.0]]
    odd = [None, [], [1.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1e300, 0.0]]
    df = spark.createDataFrame([(i if i else None, v, 1, "x", 2) for i, v in enumerate([*good, *odd])], schema)
    out = whitening.whitened_components(df).toPandas()
    assert len(out) == 8 and set(out["n"]) == {4} and out["vec_id"].isna().sum() == 2 and out["identity_error"].max() < 1e-9
    for rows in ([], odd, [good[0]] * 5):
        empty = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in enumerate(rows)], schema)
        assert whitening.whitened_components(empty).count() == 0 and whitening.whitened_components(empty).dtypes == whitening.whitened_components(df).dtypes
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 1, "x", 2) for i in range(9)], schema)
    assert sorted(r["component"] for r in whitening.whitened_components(line).collect()) == [1] * 9


def test_deviations_beyond_a_long_are_null():
    w = whitening.Whitening(10**9, np.array([5, 5]), np.array([1, 0]), np.zeros((2, 0)), np.zeros(0))
    x = np.array([[6, 5], [10**6, 5], [5, 5]])
    want = [sum((10**9 * int(a - 5) - r) ** 2 for a, r in zip(row, (1, 0), strict=True)) for row in x]
    assert w.deviation(x) == [want[0], None, want[2]] and want[1] > 2**63


def test_queries_read_whole_tables(spark):
    counts = {n: queries.queries()[n](spark, SMALL).count() for n in ("op11_merkle", "op12_outliers", "op13_whitening")}
    docs = table(spark, SMALL, "documents").count()
    assert counts == {"op11_merkle": docs, "op12_outliers": docs, "op13_whitening": 32 * table(spark, SMALL, "embeddings").where(F.size("embedding") == 64).count()}


def test_manifest_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = queries.queries()["op11_merkle"](spark, SMALL)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()['op11_merkle']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
