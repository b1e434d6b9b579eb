"""Operators beyond their queries: parts, options, and the cases that tables rarely have."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections import Counter
from itertools import product

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cortiq.llm import chat_format, components, decontaminate, exact_dedup, html_text, mixing, ngram_join, queries, token_counts, token_files, toxicity, url_filter
from cortiq.llm._shared import WordIds, words_of


def docs_of(spark, texts, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], schema)


def test_words_lower_only_ascii():
    assert [w.decode() for w in words_of("ÀÉ Ab_c1-Z é\x7fx")] == ["ÀÉ", "ab", "c1", "z", "é", "x"]


def test_winnowing_guarantee():
    """Any shared run of SPAN words has a fingerprint at the same place in both texts."""
    rng = np.random.default_rng(0)
    words = WordIds()
    for _ in range(200):
        shared = rng.integers(0, 50, decontaminate.SPAN)
        a, b = (np.concatenate([rng.integers(0, 50, rng.integers(0, 20)), shared, rng.integers(0, 50, 5)]) for _ in range(2))
        fa, fb = (decontaminate.fingerprints(np.array([words[b"%d" % w] for w in x], np.uint64), decontaminate.SPAN) for x in (a, b))
        pa, pb = len(a) - 5 - decontaminate.SPAN, len(b) - 5 - decontaminate.SPAN
        at = lambda f, p: {(int(i) - p, int(h)) for i, h in zip(*f) if 0 <= i - p <= decontaminate.SPAN - decontaminate.K}
        assert at(fa, pa) & at(fb, pb)


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(spark, docs, bench).count() == 0
    assert decontaminate.report(decontaminate.contamination(spark, docs_of(spark, ["a b"]), bench)).first()["contaminated"] is False
    assert exact_dedup.exact_duplicates(spark, docs).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(spark, docs)).count() == 0
    assert mixing.calibrated(spark, docs).count() == 0
    assert ngram_join.near_duplicates(spark, docs).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extracted(spark, pages).count() == 0
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scores(spark, docs_of(spark, ["a", None, ""]), model).where("score BETWEEN 0 AND 1").count() == 3
    assert url_filter.judged(spark, pages.select("page_id", "url"), url_filter.train(spark.createDataFrame([], "url string, blocked int"))).count() == 0
    lines = spark.createDataFrame([], "conv_id long, line_no long, text string, role string")
    assert chat_format.parsed(spark, lines.drop("role"), chat_format.learnt(lines)).count() == 0
    files = spark.createDataFrame([], "file long, ids_path string, bits int, n_ids long")
    assert token_counts.documents_in(files, 7).count() == 0


def test_rows_are_known_by_id_and_text(spark):
    """Rows that share an id, or have none, keep their own results; of rows that repeat both, the join keeps one."""
    leak, clean, other = "a b c d e f", "quite another text of words", "q w e r t y u i o p a s d f g h j k l z x c v b n m q1 q2 q3 q4"
    rows = [(None, leak, "1"), (None, None, "2"), (3, leak, "3"), (3, leak, "4"), (3, clean, "5"), (None, clean, "6"), (None, other, "7"), (9, other + " q5", "8")]
    docs = spark.createDataFrame([(i, t, "en", "s", x) for i, t, x in rows], "doc_id long, text string, lang string, source string, mark string")
    bench = spark.createDataFrame([("i", leak)], "item_id string, text string")
    found = decontaminate.report(decontaminate.contamination(spark, docs, bench)).collect()
    assert sorted((r["n_words"], r["n_hit"], r["contaminated"]) for r in found) == sorted([(6, 6, True)] * 3 + [(0, 0, False)] + [(5, 0, False)] * 2 + [(30, 0, False), (31, 0, False)])
    assert {r["mark"] for r in decontaminate.decontaminated(spark, docs, bench).collect()} == {"2", "5", "6", "7", "8"}
    assert exact_dedup.exact_duplicates(spark, docs).count() == 8
    assert token_files.read_token_files(token_files.write_token_files(spark, docs)).count() == 8
    near = ngram_join.near_duplicates(spark, docs).collect()
    assert sorted((r["class_id"] or -1, r["n_copies"], r["n_links"]) for r in near) == [(-1, 1, 0), (3, 2, 1), (3, 2, 1), (3, 3, 2), (3, 3, 2), (3, 3, 2), (9, 1, 1), (9, 1, 1)]
    kept = {r["mark"] for r in ngram_join.one_of_each(spark, docs).collect()}
    assert kept - {"3", "4"} == {"2", "5", "8"} and len(kept) == 4
    assert ngram_join.one_of_each(spark, docs.where("doc_id = 3").union(docs.where("doc_id = 3"))).count() == 2
    assert mixing.calibrated(spark, docs).count() == 8


def test_index_goes_on_between_batches(spark, tmp_path):
    """Later batches find what earlier ones had; counts run on over all of them."""
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    first = exact_dedup.exact_duplicates(spark, docs_of(spark, ["a", "b", "a"]), index)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in first.collect()} == {0: (2, 2), 1: (1, 1), 2: (2, 2)}
    later = spark.createDataFrame([(10, "b"), (11, "c"), (1, "b")] + [(20 + i, "a") for i in range(5)], "doc_id long, text string")
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in exact_dedup.exact_duplicates(spark, later, again).collect()}
    assert got == {10: (1, False, 3), 11: (11, True, 1), 1: (1, True, 3)} | {20 + i: (2, False, 7) for i in range(5)}
    exact_dedup.exact_duplicates(spark, docs_of(spark, ["a"]), again)
    assert {r["digest"]: r["copies"] for r in again.rows().collect()}[hashlib.sha256(b"a").hexdigest()] == 8
    assert again.rows().count() == 3


def test_index_join_shuffles_only_the_batch(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    index.append_new(docs_of(spark, [f"t{i}" for i in range(50)]))
    keys = spark.range(100).select(F.col("id").cast("string").alias("digest"))
    plan = keys.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_encoder_equals_the_library(spark):
    """Against a tokenizer of one's own with nothing set; special tokens' strings become their ids."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_files.default_tokenizer())
    e = token_files.Encoder(token_files.default_tokenizer(), 2)
    assert np.frombuffer(e.encode("a <|endoftext|> b"), e.kind).tolist() == [64, 220, 50256, 275]
    for t in ["a\n\n b's  c\t d ", "x" * 50 + " don't 1²3 ½a \u00ad z", "\r\n\r\n a", " ", "\n", "'s 'S a''s", "#2 <|endoftext|> end", "日本 語 mixed", "\x85 a", "a\x1cb", "ª º µ × ÷ ¼ ² ¨ ɏ Ǆ ʰ"]:
        assert np.frombuffer(e.encode(t), e.kind).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_separator_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(0)
    want, rows = set(), []
    for f, (n, kind) in enumerate(((1000, "<u2"), (0, "<u2"), (257, "<u4"), (64, "<u2"))):
        ids = rng.integers(0, 9, n).astype(kind) if f < 3 else np.ones(n, kind)
        ids.tofile(tmp_path / f"{f}.ids")
        rows.append((f, f"file://{tmp_path}/{f}.ids", 16 if kind == "<u2" else 32, n))
        start, k = 0, 0
        for i in np.flatnonzero(ids == 7):
            want.add((f, k, start, int(i) + 1 - start, True))
            start, k = int(i) + 1, k + 1
        if start < n:
            want.add((f, k, start, n - start, False))
    files = spark.createDataFrame(rows, "file long, ids_path string, bits int, n_ids long")
    got = token_counts.documents_in(files, 7, block=64).select("file", "ordinal", "start", "n_tokens", "ended").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def path_score(model, lines, states):
    """The log probability of a path of states, from the text of each line."""
    total, before = 0.0, None
    for text, s in zip(lines, states, strict=True):
        marker = next((i + 1 for i, r in reversed(list(enumerate(chat_format.ROLES))) if re.match(chat_format.marker_pattern(r), text)), 0)
        values = {"marker": marker, "length": min(int(np.log2(len(text) + 1)), 15), "asks": int(text.rstrip(" ").endswith("?")), "breaks": min(text.count("\n"), 3)}
        total += (model["start"] if before is None else model["step"][before])[s] + sum(model[k][s, v] for k, v in values.items())
        before = s
    return total


def states_of(rows):
    """States of lines in order, by their roles: a line opens a turn if the role before is another one."""
    out, before = [], None
    for r in rows:
        i = chat_format.ROLES.index(r["role"])
        out.append(2 * i + (before == i))
        before = i
    return out


def some_lines(rng, n):
    names = {"system": "System: ", "user": "User: ", "assistant": "Assistant: "}
    return [(names[r] if rng.random() < 0.5 else "") + " ".join(["x"] * int(rng.integers(1, 60))) + ("?" if rng.random() < 0.3 else "") for r in rng.choice(chat_format.ROLES, n)]


def test_decoding_is_the_best_path(spark):
    """Against all paths of short conversations, in a plain search."""
    rng = np.random.default_rng(7)
    texts = {c: some_lines(rng, int(rng.integers(1, 5))) for c in range(6)}
    rows = [(c, i, t, chat_format.ROLES[int(rng.integers(0, 3))]) for c, x in texts.items() for i, t in enumerate(x)]
    lines = spark.createDataFrame(rows, "conv_id long, line_no long, text string, role string")
    model = chat_format.learnt(lines)
    got = chat_format.parsed(spark, lines.drop("role"), model).orderBy("line_no").collect()
    for c, x in texts.items():
        best = max(path_score(model, x, p) for p in product(range(chat_format.STATES), repeat=len(x)))
        assert path_score(model, x, states_of([r for r in got if r["conv_id"] == c])) == pytest.approx(best, abs=1e-6)


def test_long_conversations_decode_as_one(spark, monkeypatch):
    """Blocks folded over several levels have a path as good as one pass over all lines, whatever the line numbers are."""
    rng = np.random.default_rng(1)
    texts = some_lines(rng, 700)
    rows = [(1, t, x, chat_format.ROLES[int(rng.integers(0, 3))]) for t, x in enumerate(texts)]
    rows += [(None, 0, "User: hi", "user"), (None, 1, "<|assistant|> hello", "assistant"), (None, None, "system: be brief", "system"), (2, 5, "same", "user"), (2, 5, "same", "user"), (2, None, "User: first", "user")]
    lines = spark.createDataFrame(rows, "conv_id long, line_no long, text string, role string")
    model = chat_format.learnt(lines)
    e = np.array([[path_score({k: v * (k not in ("start", "step")) for k, v in model.items()}, [t], [s]) for s in range(chat_format.STATES)] for t in texts])
    best = path_score(model, texts, chat_format.viterbi(model, e))
    for block, fan in ((256, 256), (8, 3), (10_000, 256)):
        monkeypatch.setattr(chat_format, "BLOCK", block)
        monkeypatch.setattr(chat_format, "FAN", fan)
        out = chat_format.parsed(spark, lines.drop("role"), model).collect()
        assert len(out) == len(rows)
        mine = sorted((r for r in out if r["conv_id"] == 1), key=lambda r: r["line_no"])
        assert path_score(model, texts, states_of(mine)) == pytest.approx(best, abs=1e-6)
        none = {r["line_no"]: (r["role"], r["rendered"]) for r in out if r["conv_id"] is None}
        assert none == {None: ("system", "<|system|>\nbe brief"), 0: ("user", "\n<|user|>\nhi"), 1: ("assistant", "\n<|assistant|>\nhello")}
        assert [r["opens"] for r in out if r["conv_id"] == 2 and r["line_no"] is None] == [True]


def test_blocks_of_repeated_numbers(spark, monkeypatch):
    """Lines that all have one number, or none, are still dealt out in blocks."""
    monkeypatch.setattr(chat_format, "BLOCK", 16)
    lines = spark.createDataFrame([(1, None, f"line {i % 3}") for i in range(200)] + [(2, 4, "x")] * 50, "conv_id long, line_no long, text string")
    ranks = chat_format.numbered(lines, ("line_no",)).toPandas()
    assert {k: sorted(g) for k, g in ranks.groupby("key")["rank"]} == {"1": list(range(200)), "2": list(range(50))}
    model = chat_format.learnt(lines.withColumn("role", F.lit("user")))
    assert chat_format.parsed(spark, lines, model).count() == 250


def test_lines_of_real_transcripts(spark):
    text = "### System\nBe brief.\n\n**Human:** What is it?\r\nAnd why?\n<|assistant|>\nA thing.\nIt is so.\nUser: thanks"
    t = spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "conv_id long, text string")
    lines = chat_format.lines_of(t)
    assert [r["text"] for r in lines.orderBy("line_no").collect()] == ["### System: Be brief.", "**Human:** What is it?", "And why?", "<|assistant|>: A thing.", "It is so.", "User: thanks"]
    said = [("System: x", "system"), ("User: why?", "user"), ("and so?", "user"), ("Assistant: because", "assistant"), ("it is long and so on and on", "assistant")] * 20
    model = chat_format.learnt(spark.createDataFrame([(9, i, *x) for i, x in enumerate(said)], "conv_id long, line_no long, text string, role string"))
    got = chat_format.parsed(spark, lines, model).orderBy("line_no").collect()
    assert [r["role"] for r in got] == ["system", "user", "user", "assistant", "assistant", "user"]
    assert "".join(r["rendered"] for r in got) == "<|system|>\nBe brief.\n<|user|>\nWhat is it?\nAnd why?\n<|assistant|>\nA thing.\nIt is so.\n<|user|>\nthanks"


def test_markers(spark):
    t = spark.createDataFrame([("Human: x",), ("**Assistant:** y",), ("[system] z",), ("### User\nq",), ("userland is",), ("A: b",), ("plain",), ("# A heading",), ("[a] b",)], "text string")
    got = [r[0] for r in t.select(chat_format.symbols(F.col("text"))["marker"]).collect()]
    assert got == [2, 3, 1, 2, 0, 3, 0, 0, 3]


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark, spark.createDataFrame(pairs, "src long, dst long")).collect()}
    alone = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: root(n) for n in parent if n not in alone}


def near_texts(n, seed=5):
    rng = np.random.default_rng(seed)
    base, texts = [f"w{i}" for i in rng.integers(0, 9999, 80)], []
    for k in range(n):
        t = list(base)
        for j in rng.integers(0, 80, int(rng.integers(0, 4))):
            t[j] = f"k{k}_{j}"
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("whole", [True, False])
def test_both_ways_of_dealing_find_all_links(spark, monkeypatch, whole):
    """A group dealt as a whole, and bucket by bucket in blocks smaller than the buckets, against all pairs."""
    texts = near_texts(60)
    links, classes = brute.links(list(enumerate(texts)))
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "WHOLE_COST", 0.0 if whole else 1e9)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(spark, docs_of(spark, texts)).collect()}
    assert got == {d: (classes[d], links[d]) for d in links} and max(links.values()) > 20


@pytest.mark.parametrize("whole", [True, False])
def test_ties_of_a_large_group(spark, monkeypatch, whole):
    """In a group where all are linked, ties are one for each node and at most one for each pair of blocks, bucket by bucket too."""
    texts = [" ".join(f"w{j}" if j != 3 * k else f"own{k}" for j in range(300)) for k in range(60)]
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    monkeypatch.setattr(ngram_join, "WHOLE_COST", 0.0 if whole else 1e9)
    edges = []
    monkeypatch.setattr(ngram_join, "components", lambda spark, e: edges.append(e) or components.components(spark, e))
    got = ngram_join.near_duplicates(spark, docs_of(spark, texts)).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 59)}
    ties = edges[-1].where("src <> dst").distinct().count()
    assert 59 <= ties < (60 + 45 if whole else 300), ties


def test_components_contract_edges(spark, monkeypatch):
    """A dense group and a long chain: each edge is joined once, later rounds see few."""
    pairs = [(i, j) for i in range(60) for j in range(i)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000 - i, 6000 + i) for i in range(50)] + [(5000, 6000 + i) for i in range(50)]
    sizes = []
    keep = components.written
    monkeypatch.setattr(components, "written", lambda spark, df, name: (lambda t: (sizes.append((name, t.count())), t)[1])(keep(spark, df, name)))
    got = {r["node"]: r["component"] for r in components.components(spark, spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {n: 0 if n < 60 else 1000 if n < 1101 else 4951 for pair in pairs for n in pair}
    edges = [n for name, n in sizes if name == "edges"]
    assert edges[0] == len(set(pairs)) and sum(edges[1:]) < 0.1 * edges[0] and edges[-1] == 0


def queries_of(spark, run):
    """How many queries Spark has run for run()."""
    ran = spark._jsparkSession.sharedState().statusStore().executionsCount
    before = ran()
    run()
    return ran() - before


def test_loops_plan_no_queries_to_count(spark):
    """A chain's components: a table a query, though loops go by what is left in one; 24 when counts were queries too."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "src long, dst long")
    assert queries_of(spark, lambda: components.components(spark, edges)) <= 13


def test_targets_take_one_query(spark):
    """The targets of all marginals are one query over the cells and not one for each marginal's total; nor do cells and ratios take one to be counted."""
    rows = [(f"s{i % 3}", f"l{i % 5}", f"t{i % 2}", 100 + i) for i in range(30)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    found = []
    assert queries_of(spark, lambda: found.append(mixing._targets(spark, cells, {"topic": {"t0": 3.0}}, mixing.TEMPER))) == 1
    got = {(r["marginal"], r["value"]): r["share"] for r in found[0].collect()}
    frame = pd.DataFrame(rows, columns=[*mixing.MARGINALS, "w"])
    frame["t"] = frame["w"] * np.prod([frame.groupby(m)["w"].transform("sum") ** (mixing.TEMPER[m] - 1) for m in mixing.MARGINALS], axis=0)
    want = {(m, k): v / frame["t"].sum() for m in mixing.MARGINALS for k, v in frame.groupby(m)["t"].sum().items()}
    assert got == pytest.approx(want | {("topic", "t0"): 1.0, ("topic", "t1"): 0.0})
    names = {n: n for n in (*mixing.MARGINALS, "tokens")}
    assert queries_of(spark, lambda: mixing.chances(spark, cells, names, None, mixing.TEMPER)) <= 5


def test_training_texts_come_as_arrow(spark, monkeypatch):
    """The texts to learn from do not stand row by row in the driver's JVM."""
    monkeypatch.delattr(type(spark.range(0)), "toPandas")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs_of(spark, ["a", None, "", "ü"]), labels, held_out=False)
    assert [(r.doc_id, r.text, r.toxic) for r in got.itertuples()] == [(0, "a", 0), (1, None, 1), (2, "", 0), (3, "ü", 1)]


def test_pruning_table():
    assert list(ngram_join._LEAST.values()) == sorted(ngram_join._LEAST.values())
    assert all(0.5 * n < m < 0.8 * n for n, m in ngram_join._LEAST.items() if n >= 75)


def test_given_targets(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en" if i % 4 else "fr", f"s{i % 3}") for i in range(600)], "doc_id long, text string, lang string, source string")
    got = mixing.calibrated(spark, docs, targets={"lang": {"en": 0.5, "fr": 0.5}}).groupBy("lang").agg(F.sum(F.col("tokens") * F.col("probability")).alias("w")).collect()
    assert got[0]["w"] == pytest.approx(got[1]["w"], rel=1e-4)
    assert mixing.calibrated(spark, docs, targets={"source": {"s0": 1.0}}).where("sampled AND source <> 's0'").count() == 0
    with pytest.raises(ValueError):
        mixing.calibrated(spark, docs, targets={"source": {"unknown": 1.0}})


@pytest.mark.parametrize("one_row", [2_000, 0])
def test_raking_meets_near_diagonal_targets(spark, monkeypatch, one_row):
    """Cells whose weight lies along the diagonal converge slowly; all marginals hold in the end, in either form."""
    monkeypatch.setattr(mixing, "ONE_ROW", one_row)
    n, rng = 3, np.random.default_rng(3)
    rows = [(f"s{i}", f"l{j}", f"t{i % 2}", 10_000 if i == j else 900) for i in range(n) for j in range(n)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    goal = pd.DataFrame(rows, columns=["source", "lang", "topic", "w"])
    goal["w"] *= rng.uniform(0.4, 2.5, len(goal))  # some weights on the same cells, so their marginals can be met
    targets = {m: goal.groupby(m)["w"].sum().to_dict() for m in mixing.MARGINALS}
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-7)
    got = mixing.raked(spark, cells, targets).toPandas()
    for m, want in targets.items():
        shares = got.groupby(m)["weight"].sum()
        assert all(shares[k] == pytest.approx(v / goal["w"].sum(), abs=1e-6) for k, v in want.items())


def test_raking_says_what_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    with pytest.raises(ValueError, match="cannot be met"):
        mixing.raked(spark, cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.5, "y": 0.5}})


def test_topics_and_tokens(spark):
    texts = {"prose": "just a few plain words of prose", "license": "Permission and copyright under the license", "contact": "mail me@example.org or 555 1234", "code": "if (x) { y = 1; } z = 2;", "table": "1 | 2 | 3 | 4", "noise": "word### of*** noise$$$", None: ""}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    names = {n: n for n in ("source", "lang", "topic", "tokens")}
    got = mixing.keyed(docs.withColumns({"source": F.lit("s"), "lang": F.lit("l")}), names).collect()
    assert [r["topic"] for r in got] == [k or "prose" for k in texts]
    assert [r["tokens"] for r in got] == [len(brute.pieces(t)) for t in texts.values()]


def test_best_run():
    assert html_text.best_run([-1, 2, -1, 3, -5, 3]) == (1, 4)
    assert html_text.best_run([]) == html_text.best_run([-1.0]) == (0, 0)


def test_pages_take_linear_time():
    counts = Counter()
    for page in html_text.made_up_pages():
        html_text.labelled_counts(page, counts)
    weights = html_text.Weights(counts)
    for bad in ("<div>", "<a x ", "<a x='", "<p><b>", "</p>", "<div class='ad'>", "<!--", "<article><div class=ad>x</div>", "<div><p>x</span>", "<"):
        began = time.process_time()
        html_text.main_text(bad * 100_000, weights)
        assert time.process_time() - began < 15, bad


def test_names_are_weighed_with_their_element():
    """Names that only hint at boilerplate don't outweigh a paragraph; blocks that labelled pages have beside articles go."""
    counts = Counter()
    for page in html_text.made_up_pages():
        html_text.labelled_counts(page, counts)
    weights = html_text.Weights(counts)
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    page = f"<nav>m</nav><article><header><h1>Title here</h1></header><p class='share-price'>{words('a', 9)}</p><p>{words('b', 30)}</p><p class='legal'>{words('c', 5)}</p><div>{words('d', 3)}</div><div class='share-buttons'>tweet</div><footer>by me</footer><div class='comment-list'>nice one</div></article><footer>all</footer>"
    assert html_text.main_text(page, weights) == f"Title here {words('a', 9)} {words('b', 30)} {words('c', 5)} {words('d', 3)}"
    unseen = Counter(counts)
    for _ in range(50):
        html_text.labelled_counts(f"<div class='zorp'><a>x</a></div><article><div class='body'><p>{words('a', 9)}</p></div></article>", unseen)
    assert html_text.Weights(unseen).boilerplate("div.zorp") and not weights.boilerplate("div.zorp")


def tree_score(model, row):
    """One row through all trees, node by node."""
    total = model.base
    for f, c, v in zip(model.feature, model.cut, model.leaf, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if row[f[node]] > c[node] else 1)
        total += v[node - len(f)]
    return 1 / (1 + np.exp(-total))


def url_row(model, url):
    """Features of a URL in plain Python."""
    rest = url.partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    path, query = re.match(r"[^?#]*", rest[len(host) :])[0], (re.search(r"\?([^#]*)", url) or [None, ""])[1]
    host = host.lower()
    counts = Counter(host)
    entropy = -sum(n / len(host) * np.log2(n / len(host)) for n in counts.values()) if host else 0.0
    labels = host.split(".")
    values = [len(url), len(host), len(path), len(labels), sum(bool(x) for x in path.split("/")), sum(c.isdigit() for c in url) / max(len(url), 1), host.count("-"), len(query.split("&")) if query else 0, len(query), entropy, max(map(len, labels)), sum(c.isdigit() for c in host), url.startswith("https://"), bool(re.search(":[0-9]+$", host)), "#" in url]
    bare = re.sub(":[0-9]*$", "", host)
    keys = ".".join(bare.split(".")[-2:]) if "." in bare else "", (re.match("/([^/]*)", path) or [None, ""])[1].lower()
    return [*map(float, values), float(len(keys[0])), math.log1p(model.often.get(keys[0], 0)), *[r.get(k, model.prior) for r, k in zip(model.rates, keys, strict=True)]]


def test_url_scores_against_plain_trees(spark):
    """Lexical labels that no single feature tells: several features are used, unseen hosts are judged well, scores are those of the trees."""
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = []
    for i in range(1500):
        bad = i % 2
        often = lambda clean, dirty: rng.random() < (dirty if bad else clean)
        name = "".join(rng.choice(letters, int(rng.integers(4, 16 if bad else 10)))) + (str(rng.integers(10, 9999)) if often(0.1, 0.6) else "") + ("-x" if often(0.2, 0.6) else "")
        query = "&".join(f"{k}={rng.integers(9)}" for k in "pqr" if often(0.2, 0.6))
        rows.append((f"http{'s' if often(0.8, 0.4) else ''}://{name}.{rng.choice(['com', 'top', 'org'], p=[0.4, 0.5, 0.1] if bad else [0.5, 0.1, 0.4])}{':81' if often(0.02, 0.1) else ''}/{rng.choice(letters)}/{rng.integers(999)}{'/x/y' if often(0.2, 0.6) else ''}{'?' + query if query else ''}", bad))
    table = spark.createDataFrame(rows, "url string, blocked int")
    model = url_filter.train(table.limit(1000))
    used = set(model.feature[np.isfinite(model.cut)].tolist())
    assert len(used) >= 6
    held = table.offset(1000).withColumns({"host": F.lit("mine"), "depth": F.lit("mine"), "features": F.lit(1), "page_id": F.monotonically_increasing_id()})
    got = url_filter.judged(spark, held, model, rules=()).collect()
    assert np.mean([(r["verdict"] == "block") == (r["blocked"] == 1) for r in got]) > 0.85
    assert {(r["own_host"], r["depth"], r["features"]) for r in got} == {("mine", "mine", 1)}
    exact = {r["url"]: list(r["features"]) for r in url_filter.featured(held).select("row.url", "features").collect()}
    for r in got[:100]:
        plain = url_row(model, r["url"])
        assert exact[r["url"]] == pytest.approx(plain[: len(exact[r["url"]])], abs=1e-9)
        # Sums in another order differ in the last bit, which a cut may see: trees get the operator's own sums.
        row = [*exact[r["url"]], *plain[len(exact[r["url"]]) :]]
        assert r["score"] == pytest.approx(tree_score(model, row), abs=1e-9)


def test_url_rules_teach_lexical_features(spark):
    """The query's own model on sf0.1 reads lexical features, no rates of suffixes or segments; what they cannot tell stays allowed."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    model = url_filter.train(url_filter.labelled_by_rules(pages), rates=False)
    used = set(model.feature[np.isfinite(model.cut)].tolist())
    assert len({f for f in used if f < len(url_filter.FEATURES)}) >= 4 and max(used) < len(url_filter.FEATURES) + 2
    got = url_filter.judged(spark, pages, model).where("rule IS NULL").toPandas()
    assert got["score"].nunique() > 100
    blocked = got[got["verdict"] == "block"]
    assert (blocked["score"] >= model.threshold).all() and len(blocked) < 0.5 * len(got)


def test_url_query_reads_counts_of_suffixes(spark, monkeypatch):
    """The query's own trees on sf0.1 read counts of suffixes or segments over all URLs, and lexical features; the counts are those of plain Python."""
    sf, models, train = "/root/testdata/sf0.1", [], url_filter.train
    monkeypatch.setattr(url_filter, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    got = queries.op7_url_filter(spark, sf).toPandas()
    used = set(models[0].feature[np.isfinite(models[0].cut)].tolist())
    first = len(url_filter.FEATURES) + 2 + len(url_filter.STATISTICS)
    assert {f for f in used if f >= first} and len({f for f in used if f < len(url_filter.FEATURES)}) >= 4
    assert not used & {first - 2, first - 1}  # no rates of labels
    free = got[got["rule"].isna()]
    assert free["score"].nunique() > 100  # more than a copy of the rules
    assert len(got) == 2500 and (free["verdict"] == "block").mean() < 0.5
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    want = Counter(".".join(r["url"].split("/")[2].lower().split(".")[-2:]) for r in pages.collect())
    assert {r["suffix"]: r["suffix_urls"] for r in url_filter.statistics_of(spark, pages)[0].collect()} == want


@pytest.mark.parametrize("rates, bins", [(False, 0), (True, 10_000)])
def test_url_trees_learn_from_all_labels(spark, monkeypatch, rates, bins):
    """More labelled URLs than the driver holds: histograms of all of them make the trees and the cut that the driver makes of them."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    labelled = url_filter.labelled_by_rules(pages) if not rates else pages.select("url", F.col("url").like("%-%").cast("int").alias("blocked"))
    statistics = None if rates else url_filter.statistics_of(spark, pages)
    monkeypatch.setattr(url_filter, "TREES", 4)
    held = url_filter.train(labelled, rates, statistics)
    monkeypatch.setattr(url_filter, "HELD_ROWS", 100)
    monkeypatch.setattr(url_filter, "HELD_BINS", bins)
    spread = url_filter.train(labelled, rates, statistics)
    assert len(spread.leaf) == 4 and spread.prior == held.prior and spread.often == held.often
    assert all(a == pytest.approx(b) for a, b in zip(spread.rates, held.rates, strict=True))
    scores = [[r["score"] for r in url_filter.judged(spark, pages, m, statistics=statistics).orderBy("page_id").collect()] for m in (held, spread)]
    assert np.abs(np.subtract(*scores)).mean() < 0.02
    assert spread.threshold == pytest.approx(held.threshold, abs=0.1)


def test_cuts_by_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    score = np.round(rng.random(600), 2)
    y = (rng.random(600) < score**0.3).astype(int)
    for buckets in (7, 65_536):
        monkeypatch.setattr(url_filter, "BUCKETS", buckets)
        table = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score, strict=True)], "y int, score double")
        assert url_filter._precise_cut_on_spark(table) == url_filter.precise_cut(score, y) < 1
        assert url_filter._precise_cut_on_spark(table.withColumn("y", F.lit(0))) == math.inf


def test_cuts_are_precise():
    y = np.array([1] * 40 + [0] * 4 + [1] * 20 + [0] * 100)
    score = np.linspace(1, 0, len(y))
    cut = url_filter.precise_cut(score, y)
    assert y[score >= cut].mean() >= 0.9 and (score >= cut).sum() >= 60
    assert url_filter.precise_cut(score, 1 - y) == math.inf and url_filter.precise_cut(np.full(30, 0.5), np.arange(30) % 2) == math.inf
    assert url_filter.precise_cut(np.zeros(0), np.zeros(0)) == math.inf


def test_no_labels_block_and_reject_nothing(spark):
    """Without labels, or with labels of one kind, only rules block and no text is toxic in its language."""
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://net/"), (3, None)], "page_id long, url string")
    for rows in ([], [("http://b.com/", 1)] * 30, [("http://b.com/", 0)] * 30):
        got = url_filter.judged(spark, pages, url_filter.train(spark.createDataFrame(rows, "url string, blocked int"))).collect()
        assert {r["page_id"]: r["verdict"] for r in got} == {1: "allow", 2: "block", 3: "allow"}
    docs = docs_of(spark, ["a b c", None, "", "d e"] * 5)
    for kind in ([], [(i, 1, 1) for i in range(20)], [(i, 1, 0) for i in range(20)], [(i, 1, None) for i in range(20)]):
        model = toxicity.train(docs, spark.createDataFrame(kind, "doc_id long, quality int, toxic int"))
        got = toxicity.scores(spark, docs, model)
        assert got.where("toxic_in_lang").count() == 0 and got.where("score >= 0.3").count() == (20 if kind and kind[0][2] else 0)


def test_a_text_too_long_to_learn_from(spark, monkeypatch):
    """It is left out; the others are learnt from."""
    monkeypatch.setattr(toxicity, "TRAIN_TEXT", 1000)
    texts = ["bad word " * 300 if i in (0, 7) else ("vile thing here" if i % 2 else "kind thing here") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs_of(spark, texts), labels, held_out=False)
    assert len(rows) == 198 and not {0, 7} & set(rows["doc_id"])
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 150)
    assert len(toxicity.training_rows(docs_of(spark, texts), labels, held_out=False)) == 10


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    assert ((url_filter.boosted(x, y).probability(x) > 0.5) == y).mean() > 0.97


def test_toxicity_scores_against_a_plain_network(spark):
    """Each filter at each place of a text, the largest value, and the output, in plain loops."""
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["bad", "good", "fine", "awful", "word", "thing", "x"], int(rng.integers(1, 12)))) for _ in range(80)]
    docs = docs_of(spark, [*texts, "", None, "one", "é ü"])
    labels = spark.createDataFrame([(i, int("bad" in t or "awful" in t)) for i, t in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    for r in toxicity.scores(spark, docs, model).collect():
        words = [model.table[toxicity.features(w)].sum(axis=0) for w in words_of(r["text"])]
        pooled = []
        for w, b in zip(model.filters, model.bias, strict=True):
            values = [sum((words[p + j] @ w[j] for j in range(len(w)) if p + j < len(words)), np.zeros(len(b))) + b for p in range(len(words))] or [b]
            pooled.extend(np.maximum(np.max(values, axis=0), 0))
        z = model.slope * (np.array(pooled) @ model.out + model.offset) + model.shift
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_toxicity_training_rows(spark, monkeypatch):
    """Labels that repeat an id are toxic if one is; one text for an id; whole texts up to the bound of bytes."""
    docs = spark.createDataFrame([(i, "word " * (i + 1), "en") for i in range(20)] + [(3, "another", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0) for i in range(20)] + [(3, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, held_out=False)
    assert got["doc_id"].tolist() == list(range(20)) and got["toxic"].sum() == 1 and got["toxic"][got["doc_id"] == 3].item() == 1
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 300)
    some = toxicity.training_rows(docs, labels, held_out=False)
    assert 0 < len(some) < 20 and some["text"].str.len().sum() <= 300 and set(some["text"]) <= set(got["text"])


def test_very_long_texts(spark):
    text = " ".join(f"word{i % 997} goes{i % 13}" for i in range(30_000))
    docs = docs_of(spark, [text, text + " end", "short one", "another bad one"])
    assert ngram_join.near_duplicates(spark, docs).where("class_id = 0").count() == 2
    model = toxicity.train(docs, spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, toxic int"))
    assert toxicity.scores(spark, docs, model).count() == 4
    pages = spark.createDataFrame([(0, "u", f"<article><p>{text}</p></article>")], "page_id long, url string, html string")
    assert html_text.extracted(spark, pages).first()["n_chars"] == len(text)
    lines = spark.createDataFrame([(1, 0, text, "user")], "conv_id long, line_no long, text string, role string")
    assert chat_format.parsed(spark, lines, chat_format.learnt(lines)).first()["rendered"].endswith(text)


@pytest.mark.parametrize("name", ["toxicity", "ngram_join", "decontaminate", "token_files"])
def test_long_texts_reach_workers_in_small_batches(spark, name):
    """Once an operator has planned its work, rows go to a Python worker by a megabyte and not by Spark's 64; a user's own bound stays."""
    bound, docs = "spark.sql.execution.arrow.maxBytesPerBatch", docs_of(spark, ["a b c", None, ""])
    run = {
        "toxicity": lambda: toxicity.scores(spark, docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))),
        "ngram_join": lambda: ngram_join.near_duplicates(spark, docs),
        "decontaminate": lambda: decontaminate.contamination(spark, docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")),
        "token_files": lambda: token_files.write_token_files(spark, docs),
    }[name]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]})

    before = spark.conf.get(bound, None)
    try:
        spark.conf.unset(bound)
        run()
        long = spark.range(0, 600, 1, 1).select("id", F.repeat(F.lit("word "), 4_000).alias("text"))
        got = long.mapInArrow(sizes, "rows long, size long").collect()
        assert sum(r["rows"] for r in got) == 600 and max(r["size"] for r in got) <= 2**20 + 30_000
        spark.conf.set(bound, "3m")
        run()
        assert spark.conf.get(bound) == "3m"
    finally:
        spark.conf.unset(bound) if before is None else spark.conf.set(bound, before)


def test_pipeline(spark):
    """run() on the small tables against a brute-force pass over its stages' decisions."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [s for s, _ in corpus_pipeline.STAGES][1] == "near copies"
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
    want = {r["doc_id"]: r["text"] for r in kept.collect()}
    import brute
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == brute.token_rows(sorted(want.items()), t)
    sets = {d: brute.shingles(x) for d, x in want.items()}
    assert all(brute.jaccard(sets[a], sets[b]) < 0.8 for a in sets for b in sets if a < b and sets[a] and sets[b])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(r[5] for r in brute.contamination(want.items(), items))


def test_pipeline_on_hard_rows(spark, tmp_path):
    """Repeated and null ids, and a table's own columns named like helpers, through all stages but the sampling."""
    clean = [" ".join(f"c{k}w{i}" for i in range(30)) for k in range(12)]
    leak = " ".join(f"leak{i}" for i in range(12))
    rows = [(k, t) for k, t in enumerate(clean)] + [(None, "null id " + clean[0]), (1, "same id other text " + clean[3].replace("c3", "d3")), (2, clean[2]), (50, clean[2]), (4, "x " + leak), (None, leak), (7, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "mine", 0.5, "h", "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, item_id string, score double, host string, node string")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, sf)
    assert calm.columns == docs.columns and calm.count() == docs.count()  # no toxic label: nothing is rejected
    one = stages["near copies"](spark, docs, sf)
    left = sorted(((r["doc_id"], r["text"]) for r in one.collect()), key=str)
    # Gone: a near copy without an id, a row that repeats another, a copy with a larger id, and a near copy of the leak.
    want = sorted((r for k, r in enumerate(rows) if k not in (12, 14, 15, 17)), key=str)
    assert one.columns == docs.columns and left == want
    kept = stages["decontamination"](spark, one, sf)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([r for r in want if leak not in (r[1] or "")], key=str)
    mixed = stages["mixing"](spark, kept, sf)
    assert mixed.columns == docs.columns and {(r["score"], r["host"], r["node"], r["item_id"]) for r in mixed.collect()} <= {(0.5, "h", "k", "mine")}
    assert stages["token files"](spark, kept, sf).count() == kept.count()
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_extra_columns_with_clashing_names(spark):
    names = ("score", "toxic_in_lang", "hit_id", "keep_id", "n_words", "node", "copies", "probability", "label_id", "dropped_id", "digest")
    docs = docs_of(spark, ["a b c d e f g h", "x y z", None]).select("*", *[F.lit("x").alias(n) for n in names])
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert toxicity.scores(spark, docs, toxicity.train(docs, labels)).count() == 3
    assert ngram_join.one_of_each(spark, docs).columns == docs.columns
    assert decontaminate.decontaminated(spark, docs, bench).count() == 2
    assert mixing.mixed_documents(spark, docs).columns == docs.columns
    assert exact_dedup.exact_duplicates(spark, docs).count() == 3
    assert token_files.read_token_files(token_files.write_token_files(spark, docs)).count() == 3
    assert queries.QUERIES.keys() >= queries.SQL.keys()


def test_topics_change_probabilities(spark):
    """Within a source and a language, a rare topic is more likely to be sampled than a frequent one, and given targets of one marginal alone move it."""
    rows = [(i, "plain words of prose here " * 4 if i % 10 else "if (a) { b; } else { c = d; } " * 4, ("en", "fr")[i % 3 == 0], f"s{i % 2}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.calibrated(spark, docs).groupBy("source", "lang", "topic").agg(F.max("probability").alias("p"), F.min("probability").alias("q")).collect()
    by = {(r["source"], r["lang"], r["topic"]): r["p"] for r in got}
    assert all(r["p"] == r["q"] for r in got)
    cells = {(s, x) for s, x, t in by if t == "code"} & {(s, x) for s, x, t in by if t == "prose"}
    assert cells and all(by[s, x, "code"] > by[s, x, "prose"] for s, x in cells)
    asked = mixing.calibrated(spark, docs, {"topic": {"code": 1.0, "prose": 1.0}}).groupBy("topic").agg(F.sum(F.col("tokens") * F.col("probability")).alias("w")).collect()
    w = {r["topic"]: r["w"] for r in asked}
    assert w["code"] == pytest.approx(w["prose"], rel=1e-3)


def test_texts_that_only_look_like_boilerplate(spark):
    """Formulas, old preformatted text and an object's own text are text."""
    page = "<html><body><nav>menu one two</nav><article><p>First words of the text.</p><math><mi>x</mi><mo>=</mo><mn>2</mn></math><xmp>plain code here</xmp><object data='a.svg'>A picture in words.</object><p>Last words of the text.</p></article></body></html>"
    got = html_text.extracted(spark, spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()["text"]
    for words in ("First words of the text.", "x=2", "plain code here", "A picture in words.", "Last words of the text."):
        assert words in got or words.replace("=", " = ") in got, got
    assert "menu" not in got


def test_best_run_against_all_pairs():
    rng = np.random.default_rng(12)
    for _ in range(300):
        s = rng.integers(-4, 5, int(rng.integers(0, 25))).tolist()
        sums = {(a, b): sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        top = max(sums.values(), default=0)
        want = min(((a, b) for (a, b), v in sums.items() if v == top), key=lambda r: (r[1], -r[0])) if top > 0 else (0, 0)
        got = html_text.best_run(s)
        assert (sum(s[slice(*got)]) == max(top, 0)) and got[1] == want[1]


def test_links_just_above_the_threshold(spark):
    """Pairs at a similarity of 0.80 to 0.86, where the bands are thinnest, and pairs just below it."""
    rng = np.random.default_rng(71)
    texts, want = [], []
    for k in range(120):
        words = [f"v{k}w{i}" for i in range(200)]
        t = int(rng.integers(15, 22)) if k % 2 else int(rng.integers(23, 28))  # the last t words differ: (196 - t) / (196 + t)
        texts += [" ".join(words), " ".join(words[: 200 - t] + [f"n{k}w{i}" for i in range(t)])]
        want += [k % 2] * 2
    got = ngram_join.near_duplicates(spark, docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_links"] for r in got] == want
    assert all(r["class_id"] == r["doc_id"] - (r["doc_id"] % 2 if w else 0) for r, w in zip(got, want, strict=True))


def test_long_texts_in_blocks_of_their_own(spark, monkeypatch):
    """Blocks that hold few shingles give the same links."""
    rng = np.random.default_rng(72)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 3000)]
    texts = [" ".join(base[:2990] + [f"x{k}y{i}" for i in range(10)]) for k in range(9)] + [" ".join(f"o{k}p{i}" for i in range(3000)) for k in range(3)]
    whole = sorted(map(tuple, ngram_join.near_duplicates(spark, docs_of(spark, texts)).collect()))
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 5_000)
    assert sorted(map(tuple, ngram_join.near_duplicates(spark, docs_of(spark, texts)).collect())) == whole
    assert [r[4] for r in whole] == [8] * 9 + [0] * 3
