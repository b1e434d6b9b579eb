"""The audit of sources against SQL, and by plain counting."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cortiq.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, item string, rank string"


def corpus():
    rng = np.random.default_rng(5)
    words = ["été", "Straße", "the", "THE", "日本"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    p = 1 / np.arange(1, len(words) + 1)
    docs = []
    for i in range(400):
        lang = ("en", "de", None, "")[i % 4]
        source = "hot" if i % 3 == 0 else ("s1", "s2", None, "tiny")[i % 4 if i < 390 else 3]
        text = " ".join(rng.choice(np.roll(words, 7 * (source == "s1")), int(rng.integers(1, 60)), p=p / p.sum()))
        docs.append((i, None if i % 50 == 0 else "" if i % 51 == 0 else text + "1x_y İÀ", lang, source, "x", "y"))
    docs += [(1000, "Only here, ONCE", "fr", "alone", "", ""), (1001, None, "it", "a", "", ""), (1002, "", "it", "b", "", ""), (3, "the same id", "en", "hot", "", "")]
    docs.append((2000, "long " * 50_000, "en", "hot", "", ""))
    return docs


def brute(docs, least, top):
    counts, seen, groups = {}, {}, set()
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall((text or "").translate(LOWER))
        counts.setdefault((lang, source), Counter()).update(found)
        seen.setdefault(lang, Counter()).update(set(found))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in seen.items()}
    p = {}
    for lang in {g[0] for g in groups}:
        total = Counter()
        for g in groups:
            if g[0] == lang:
                total.update(counts[g])
        for key, c in [((lang, None), total), *[(g, counts[g]) for g in groups if g[0] == lang]]:
            n = sum(c[t] for t in kept[lang])
            p[key] = {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept[lang])) for t in kept[lang]}
    out = []
    for g in groups:
        pairs = [(-sum(abs(p[g][t] - p[h][t]) for t in kept[g[0]]), h[1].encode()) for h in groups if h[0] == g[0] and h != g]
        out += [(*g, "pair", h.decode(), -f, r + 1) for r, (f, h) in enumerate(sorted(pairs))]
        terms = [(p[g[0], None][t] - p[g][t], t.encode()) for t in kept[g[0]] if counts[g][t] and p[g][t] > p[g[0], None][t]]
        out += [(*g, "term", t.decode(), -f, r + 1) for r, (f, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(30, 50), (2, 3), (1, 5), (10_000, 50)])
def test_against_counting_and_sql(spark, least, top):
    docs = corpus()
    got = sorted(tuple(r) for r in divergence.divergence(spark, spark.createDataFrame(docs, SCHEMA).repartition(5), least, top).collect())
    assert got == brute(docs, least, top)
    con = duckdb.connect()
    table = spark.createDataFrame(docs, SCHEMA).toArrow()
    con.register("documents", table)
    assert got == sorted(con.execute(divergence.oracle(least, top)).fetchall())


def test_small_blocks(spark, monkeypatch):
    """Sums that leave a task early, and postings that are expanded a few at a time."""
    docs = corpus()
    rows = [d for d in docs if d[2] == "en"]
    batch = lambda has: pa.RecordBatch.from_pydict({"lang": ["a"] * len(has), "has": has})
    has = [[{"no": i, "p": 10 * i + k, "base": 3 * i} for i in range(2 + k % 5)] for k in range(40)]
    whole = Counter()
    for part in divergence._common(iter([batch(has)])):
        for r in part.to_pylist():
            whole[r["one"], r["two"]] += r["extra"]
    monkeypatch.setattr(divergence, "EXPAND", 3)
    monkeypatch.setattr(divergence, "TASK_PAIRS", 2)
    parts = Counter()
    for part in divergence._common(iter([batch(has[:15]), batch(has[15:])])):
        for r in part.to_pylist():
            parts[r["one"], r["two"]] += r["extra"]
    assert parts == whole and len(whole) == 15
    for (i, j), extra in whole.items():
        both = [(x[i], x[j]) for x in has if len(x) > j]
        assert extra == sum(abs(a["p"] - b["p"]) - abs(a["p"] - b["base"]) - abs(a["base"] - b["p"]) + abs(a["base"] - b["base"]) for a, b in both)
    monkeypatch.setattr(divergence, "TASK_TERMS", 20)
    text = pa.RecordBatch.from_pydict({"text": [r[1] or "" for r in rows], "lang": ["en"] * len(rows), "source": [r[3] or "" for r in rows]})
    n = Counter()
    for part in divergence._counts(iter([text])):
        for r in part.to_pylist():
            n[r["term"]] += r["n"]
    assert n["the"] == sum(TERM.findall((r[1] or "").translate(LOWER)).count("the") for r in rows)


def test_bounds_leave_buckets_unseen(spark):
    """The best terms of a group with many terms are found without evaluating all of its buckets."""
    docs = [(i, " ".join(f"c{'x' * (j % 7)}{chr(97 + j % 26)}" for j in range(i % 90)), "en", f"s{i % 3}", "", "") for i in range(400)]
    audit = divergence.Audit(spark, spark.createDataFrame(docs, SCHEMA), 1)
    seen = []
    whole = audit.evaluated
    audit.evaluated = lambda chosen: seen.append(chosen.count()) or whole(chosen)
    got = audit.terms(2).count()
    assert got == 6 and sum(seen) < audit.buckets().count()


def test_empty(spark):
    assert divergence.divergence(spark, spark.createDataFrame([], SCHEMA)).count() == 0
