from __future__ import annotations

import gzip
import numpy as np
import pytest
from pyspark.sql import functions as F

from cortiq.sources import arrays, catalog, datasets


def test_npy_and_sparse(spark, tmp_path):
    a = np.random.default_rng(0).standard_normal((5, 3))
    np.save(tmp_path / "a.npy", a)
    got = arrays.load(spark, str(tmp_path / "a.npy")).toPandas()
    out = np.zeros((5, 3))
    out[got["i"], got["j"]] = got["x"]
    np.testing.assert_array_equal(out, a)
    np.savez(tmp_path / "m.npz", format="csr", shape=(2, 3), indptr=[0, 1, 3], indices=[2, 0, 1], data=[1.0, 2.0, 3.0])
    rows = arrays.load(spark, str(tmp_path / "m.npz")).select("src", "dst", "w").collect()
    assert {tuple(r) for r in rows} == {(0, 2, 1.0), (1, 0, 2.0), (1, 1, 3.0)}
    np.savez(tmp_path / "r.npz", concatenated_searchlights=[4, 5, 6], concatenated_distances=[0.0, 1.0, 0.0], boundaries=[2])
    rows = arrays.read_neighborhoods(spark, str(tmp_path / "r.npz")).select("center", "pos", "v").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 4), (0, 1, 5), (1, 0, 6)]


def test_tables_and_dispatch(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\tn/a\n2\t3\n")
    assert [tuple(r) for r in arrays.load(spark, str(tmp_path / "t.tsv")).collect()] == [(1, None), (2, 3)]
    for name, text in (("u.tsv.gz", "a\tb\n1\tn/a\n2\t3\n"), ("u.csv.gz", "a,b\n1,n/a\n2,3\n")):
        (tmp_path / name).write_bytes(gzip.compress(text.encode()))
        assert [tuple(r) for r in arrays.load(spark, str(tmp_path / name)).collect()] == [(1, None), (2, 3)]
    (tmp_path / "v.txt").write_text("one\ntwo\n")
    assert [r["value"] for r in arrays.load(spark, str(tmp_path / "v.txt")).collect()] == ["one", "two"]
    arrays.save(spark.range(3), str(tmp_path / "x.parquet"))
    assert arrays.load(spark, str(tmp_path / "x.parquet")).count() == 3
    for f in (lambda: arrays.load(spark, "x.pkl"), lambda: arrays.save(spark.range(1), "x.pkl")):
        with pytest.raises(TypeError):
            f()
    calls = []
    make = lambda: calls.append(1) or spark.range(2)
    assert arrays.memoised(spark, str(tmp_path / "memo"), make).count() == arrays.memoised(spark, str(tmp_path / "memo"), make).count() == 2
    assert len(calls) == 1


@pytest.mark.parametrize("names", [("a", "b"), ("v1.5 (old)+x", "v2.0")])
def test_compared_folders(spark, tmp_path, names):
    """Also for names without a suffix below folders with dots and signs."""
    for side in names:
        (tmp_path / side / "sub.d").mkdir(parents=True)
        (tmp_path / side / "same").write_text("x")
        (tmp_path / side / "sub.d" / "same").write_text("y")
        (tmp_path / side / "other").write_text(side)
    (tmp_path / names[0] / "mine").write_text("x")
    (tmp_path / names[1] / "theirs.txt").write_text("x")
    got = {r["path"]: r["status"] for r in arrays.compared(spark, *[str(tmp_path / n) for n in names]).collect()}
    assert got == {"same": "same", "sub.d/same": "same", "other": "differs", "mine": "only left", "theirs.txt": "only right"}


RUN = {"dataset": "raiders", "version": "23.2.0", "task": "raiders"}


def stored(spark, c, name, rows, schema, by, **tokens):
    df = spark.createDataFrame(rows, schema)
    for k, v in tokens.items():
        df = df.withColumn(k, F.lit(v))
    c.write(df, name, [*tokens, *by])


@pytest.fixture(scope="module")
def raiders(spark, tmp_path_factory):
    """Two subjects whose runs differ in length; a confound that equals the signal of vertex 0; a mask without vertex 2."""
    c = catalog.Catalog(spark, str(tmp_path_factory.mktemp("catalog")))
    rng = np.random.default_rng(4)
    x = {(s, run): rng.standard_normal((n, 6)) for s, run, n in (("s1", 1, 40), ("s1", 4, 31), ("s2", 1, 35), ("s2", 4, 50))}
    cells = [(s, run, h, t, v, float(a[t, v + 3 * (h == "r")])) for (s, run), a in x.items() for h in "lr" for t in range(len(a)) for v in range(3)]
    space = {"space": "onavg-ico32", "resample": "1step_pial_overlap"}
    stored(spark, c, "signal", cells, "subject string, run int, hemi string, t int, v int, x double", ["hemi", "subject", "run"], **RUN, **space)
    points = [(s, run, t) for (s, run), a in x.items() for t in range(len(a))]
    stored(spark, c, "confounds", [(*p, [float(x[p[:2]][p[2], 0])]) for p in points], "subject string, run int, t int, c array<double>", ["subject", "run"], **RUN)
    stored(spark, c, "kept", [(*p, p[2] % 4 != 1) for p in points], "subject string, run int, t int, keep boolean", ["subject", "run"], **RUN)
    stored(spark, c, "design", [("s1", 1, "onset", 2.5)], "subject string, run int, name string, value double", ["subject", "run"], **RUN)
    tokens = {"which": "aparc.a2009s", "group": "on1031_trimmed", "resample": "overlap-8div", "space": "onavg-ico32"}
    stored(spark, c, "masks", [(h, v, v != 2) for h in "lr" for v in range(3)], "hemi string, v int, keep boolean", ["hemi"], **tokens)
    return c, x


def cut(a, run):
    return a[:-10] if run == 1 else a[10:]


def test_data_is_cut_with_its_confounds(raiders):
    """The residual of a signal on a confound that equals it is zero only if both are cut alike, by each run's own length."""
    c, x = raiders
    d = c.dataset("raiders")
    plain = d.data("raiders", "l", prep_options={"z": False}, concat=False).toPandas()
    assert set(plain["v"]) == {0, 1} and plain[plain["v"] == 0]["x"].abs().max() < 1e-12
    for (s, run), a in x.items():
        a = cut(a, run)
        want = a[:, 1] - a[:, 0] * (a[:, 0] @ a[:, 1]) / (a[:, 0] @ a[:, 0])
        got = plain[(plain["subject"] == s) & (plain["run"] == run) & (plain["v"] == 1)].sort_values("t")
        assert got["t"].tolist() == list(range(len(a)))
        np.testing.assert_allclose(got["x"], want, atol=1e-12)
    both = d.data("raiders", "lr", mask=False).toPandas()
    assert {s: g["t"].max() + 1 for s, g in both.groupby("subject")} == {"s1": 30 + 21, "s2": 25 + 40} and set(both["v"]) == set(range(6))


def test_data_scrubs_and_takes_functions(raiders, spark):
    c, x = raiders
    d = c.dataset("raiders", preparation="scrub")
    got = d.data("raiders", "r", subject="s2", mask=False).toPandas()
    rows = [cut(np.column_stack([a, np.arange(len(a)) % 4 != 1]), run) for (s, run), a in sorted(x.items()) if s == "s2"]
    out = []
    for a in rows:
        a = a[a[:, 6] == 1]
        y, conf = a[:, 3:6], a[:, [0]]
        y = y - conf @ np.linalg.lstsq(conf, y, rcond=None)[0]
        out.append((y - y.mean(0)) / y.std(0))
    np.testing.assert_allclose(got.sort_values(["t", "v"])["x"].to_numpy().reshape(-1, 3), np.concatenate(out), atol=1e-9)
    raw = d.data("raiders", "l", subject="s1", run=4, preparation=lambda signal, confounds, keep, mask: signal, concat=False)
    assert raw.agg(F.max("t")).first()[0] == 20 and raw.select("v").distinct().count() == 3
    own = catalog.Dataset(**{f: getattr(d, f) for f in d.__dataclass_fields__} | {"slicer": lambda table, signal, task: table.where("t < 5")})
    assert own.data("raiders", "l", concat=False).agg(F.max("t")).first()[0] == 3  # of five time points one is scrubbed
    assert d.signal("raiders", force_volume=True).count() == 0
    with pytest.raises(RuntimeError):
        d.contrasts("raiders", "l")


def test_accessors(raiders, spark):
    c, _ = raiders
    d = c.dataset("raiders")
    matrix, named, kept = d.confounds("raiders", subject="s1", run=1)
    assert matrix.count() == kept.count() == 40 and named is None
    assert d.design("raiders", subject="s1").first()["value"] == 2.5
    assert c.mask("lr").where("keep").count() == 4 and c.mask("lr").agg(F.max("v")).first()[0] == 5
    tokens = {"dataset": "raiders", "version": "23.2.0", "space": "onavg-ico32"}
    rows = [(w, "s1", "l", v, float(v)) for w in ("sulc", "aparc.annot") for v in range(3)]
    stored(spark, c, "anatomy", rows, "which string, subject string, hemi string, v int, x double", ["which", "subject", "hemi"], **tokens)
    assert d.morphometry("sulc", "l", "s1").count() == 2 and d.parcellation("aparc", "l", mask=False).count() == 3
    tokens = {"space": "onavg-ico32", "group": "on1031_trimmed", "resample": "overlap-8div"}
    stored(spark, c, "morphometry", [("sulc", "l", 0, 1.0)], "which string, hemi string, v int, x double", ["which", "hemi"], **tokens)
    stored(spark, c, "parcellations", [("aparc", "l", 0, 4)], "which string, hemi string, v int, label int", ["which", "hemi"], **tokens)
    stored(spark, c, "parcellations_prob", [("aparc", "l", 4, 0, 0.75)], "which string, hemi string, label int, v int, p double", ["which", "hemi"], **tokens)
    assert c.morphometry("sulc", "l").first()["x"] == 1.0 and c.parcellation("aparc", "l").first()["label"] == 4
    assert c.parcellation("aparc", "l", prob=True).first()["p"] == 0.75
    stored(spark, c, "faces", [("l", 0, 0, 1, 2)], "hemi string, f int, a int, b int, c int", ["hemi"], space="onavg-ico32")
    stored(spark, c, "geometry", [(w, "l", g, v, 1.0, 0.0, 0.0) for w, g in (("sphere.reg", "none"), ("pial", "on1031_trimmed")) for v in range(3)], "which string, hemi string, group string, v int, x double, y double, z double", ["which", "hemi", "group"], space="onavg-ico32")
    assert c.geometry("sphere", "l").vertices.count() == 3 and c.geometry("pial", "l", vertices_only=True).count() == 3 and c.geometry("faces", "l").count() == 1
    near = [("l", i, j, float(10 * abs(i - j))) for i in range(3) for j in range(3)]
    stored(spark, c, "neighborhoods", near, "hemi string, center int, v int, dist double", ["hemi"], space="onavg-ico32", center_space="onavg-ico32")
    assert c.searchlights("l", 10, mask=True).count() == 4 and c.searchlights("l", 10).count() == 7
    contrast = [("s1", 1, "l", "t", "default", "faces", 0, 2.0)]
    stored(spark, c, "contrasts", contrast, "subject string, run int, hemi string, kind string, prep string, contrast string, v int, x double", ["subject", "run", "hemi", "kind", "prep"], **RUN, space="onavg-ico32", resample="1step_pial_overlap")
    assert d.contrasts("raiders", "l").first()["contrast"] == "faces"
    for f in (lambda: c.dataset("unknown"), lambda: c.morphometry("size", "l"), lambda: c.parcellation("x", "l"), lambda: c.mask("l", "onavg-ico32", legacy=True)):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(RuntimeError):
        c.table("absent")
    assert c.table("absent", on_missing="ignore") is None


def test_datasets(spark, tmp_path):
    rows = {r["name"]: r for r in datasets.datasets(spark).collect()}
    assert len(rows) == 22 and rows["hca"]["version"] == "HCA2.0" and rows["ibc"]["version"] == "23.2.0" and rows["praiders"]["stored"] == "raiders"
    assert rows["dalmatians"]["subjects"] == 50 and rows["bologna"]["subjects"] == 69 and len(rows["life"]["conditions"]) == 29
    c = catalog.Catalog(spark, str(tmp_path))
    assert c.dataset("monkey-kingdom").name == "monkeykingdom" and c.dataset("life").subjects("attention").count() == 12
    assert c.dataset("raiders").subjects().orderBy("subject").first()["subject"] == "sid000005"
    (tmp_path / "camcan" / "subject_sets").mkdir(parents=True)
    (tmp_path / "camcan" / "subject_sets" / "rest.txt").write_text("CC1\nCC2\n")
    assert [r["subject"] for r in c.dataset("camcan").subjects("rest").collect()] == ["CC1", "CC2"]


def test_unknown_names_raise(spark):
    for row in (("spacetop", "1", "faces", 1), ("raiders", "1", "movie", 1), ("whiplash-c1", "1", "whiplash", 2), ("raiders", "1", "actions", 9)):
        with pytest.raises(Exception, match="no name for task"):
            datasets.file_names(spark.createDataFrame([row], "dataset string, subject string, task string, run int")).collect()
