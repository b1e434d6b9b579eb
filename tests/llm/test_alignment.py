"""Links between the tokens of two tokenizers against plain loops."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from cortiq.llm import alignment, queries

SCHEMA = "doc_id long, text string, pair string, n_a int"


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(alignment.default_tokenizer())
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}
    counts, rows = Counter(), []
    for text in texts:
        whole = b" " + (text or "").encode()
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        said_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        said_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(said_a) != whole or b"".join(said_b) != whole:
            rows.append(([], [], [], []))
            continue
        spans = []
        for said in (said_a, said_b):
            at, out = 0, []
            for s in said:
                out.append((at, at + len(s)))
                at += len(s)
            spans.append(out)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, begin = [], 0
        for cut in cuts:
            inside = [",".join(str(i) for i, (s, e) in zip(ids, sp, strict=True) if begin <= s and e <= cut) for ids, sp in zip((a, b), spans, strict=True)]
            groups.append("|".join(inside))
            begin = cut
        pairs = [(i, j) for i, (s, e) in zip(a, spans[0], strict=True) for j, (t, f) in zip(b, spans[1], strict=True) if s < f and t < e]
        counts.update(pairs)
        rows.append((a, b, groups, pairs))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    return [(len(a), len(b), len(g), len(p), sum(counts[x] == most[x[1]] for x in p), sum(counts[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, p in rows]


def texts():
    rng = np.random.default_rng(6)
    words = ["the", "Straße", "naïveté", "日本語", "tokenization", "...", "12345", "\n", "  ", "\t", "😀", "don't", "a b", "é"]
    found = [" ".join(rng.choice(words, int(rng.integers(1, 40)))) for _ in range(60)]
    found += [None, "", " ", "  lead", "trail  ", "a <|endoftext|> b", "</s><s> <unk>", "<0x41>", "▁", "a▁b", "\x00\x01", "x" * 3000, "the " * 5000, found[0], found[0]]
    return found


@pytest.mark.parametrize("table", [2**18, 20, 0])
def test_against_loops(spark, table, monkeypatch):
    said = texts()
    df = spark.createDataFrame([(None if i == 5 else i, t, "x", 7) for i, t in enumerate(said)], SCHEMA).repartition(3)
    got = sorted(alignment.aligned(spark, df, table=table).collect(), key=lambda r: -1 if r[0] is None else r[0])
    want = brute(said)
    want = [want[5], *want[:5], *want[6:]]
    assert [tuple(r)[1:] for r in got] == want
    assert [r[0] for r in got] == [None, *[i for i in range(len(said)) if i != 5]]


def test_small_chunks_and_counts(spark):
    """Chunks of a text each and partial counts sent at once change nothing."""
    import pyarrow as pa

    said = [t for t in texts() if t]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(said))), "text": said})
    assert [x.stop - x.start for x in alignment.chunks([5, 1, 1, 9, 0], 2)] == [1, 2, 1, 1]
    sizes = alignment.byte_lengths()
    whole = Counter()
    rows = spark.createDataFrame(pa.Table.from_batches([batch]).to_pandas())
    table = alignment.encoded(spark, rows).toArrow().combine_chunks().to_batches()
    for part in alignment._counter(*sizes)(iter(table)):
        whole.update(dict(zip(part.column("pair").to_pylist(), part.column("n").to_pylist(), strict=True)))
    old, alignment.CHUNK, alignment.TASK_PAIRS = (alignment.CHUNK, alignment.TASK_PAIRS), 10, 3
    try:
        parts = Counter()
        for one in table:
            for chunk in alignment._linked(one, *sizes):
                parts.update(chunk[1].tolist())
    finally:
        alignment.CHUNK, alignment.TASK_PAIRS = old
    assert parts == whole


def test_links_and_groups_of_cuts():
    a, b = np.array([2, 5, 6, 10]), np.array([1, 5, 8, 10])
    left, right = alignment.links(a, b)
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 2), (3, 3)]
    cuts, group_a, group_b = alignment.group_labels(a, b)
    assert cuts.tolist() == [5, 10] and group_a.tolist() == [0, 0, 1, 1] and group_b.tolist() == [0, 0, 1, 1]
    speller = alignment.Speller(4, 4)
    codes = speller.codes(np.array([0, 1, 2, 3]), np.array([3, 2, 1, 0]), group_a, group_b)
    assert [bytes(x) for x in speller.texts(codes, np.array([0, 4, 4, 8]))] == [b"", b"0,1|3,2", b"", b"2,3|1,0"]


def test_empty_and_query(spark, tmp_path):
    assert alignment.aligned(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    said = texts()[:30]
    spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(said)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op12_alignment(spark, str(tmp_path)).collect())
    assert [r[1:] for r in got] == brute(said)
