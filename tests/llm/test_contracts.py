"""Each registered query against a brute-force version on a small fixture with the hard cases in it."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from cortiq.llm import queries

TRICKY = "WORDS, of A text; with_under\tlines\n naïve ÀB İ 12ab " * 3


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with copies, near copies, leaks, nulls, empties, a very long text and extra columns; and their tables."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    line = lambda n: " ".join(rng.choice(vocabulary, n))
    texts = [line(int(rng.integers(3, 120))) for _ in range(40)]
    base = line(120).split()
    for k in range(30):  # near copies of one text, each with a few words of its own
        near = list(base)
        for j in rng.integers(0, 120, 2):
            near[j] = f"n{k}x{j}"
        texts.append(" ".join(near))
    texts += ["a <|endoftext|> b", "<|endoftext|>", "tabs\tand\x00\x1f\x85control\x7f", "日本語 mixed 12ü", "a\u00a0b\u2003c"]
    texts += [texts[0]] * 5 + [texts[3].upper()] + [None, None, "", "  ", "...", "one", "one two", "ONE two!", TRICKY]
    items = [(str(k), line(int(n))) for k, n in enumerate((30, 15, 10, 9, 4, 1, 12))] + [("dup", None), ("empty", "!!"), ("7", TRICKY)]
    items.append(("0b", items[0][1]))
    for k in range(12):
        words = line(60).split()
        leak = items[k % 7][1].split()
        words[20:20] = leak if k < 7 else leak[: max(1, len(leak) - 2)]
        texts.append(" ".join(words))
    texts.append(" ".join([line(3000), items[0][1], line(3000), items[0][1]]))
    docs = [(i, t, ("en", "fr", None)[i % 3], ("hot" if i % 2 else f"s{i % 4}") if i != 9 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    labels = [(i, 1, int("w7" in (t or "").split())) for i, t in enumerate(texts)]
    sf = write(
        spark,
        tmp_path_factory.mktemp("corpus"),
        documents=(docs, "doc_id long, text string, lang string, source string, n_chars long, item_id string"),
        benchmark=(items, "item_id string, text string"),
        labels=(labels, "doc_id long, quality int, toxic int"),
    )
    return sf, [(d[0], d[1]) for d in docs], items, docs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_decontamination(spark, corpus):
    sf, docs, items, _ = corpus
    want = brute.contamination(docs, items)
    assert sum(r[5] for r in want) >= 8
    assert rows(queries.op1_decontamination(spark, sf)) == sorted(want)


def test_exact_dedup(spark, corpus):
    sf, docs, _, _ = corpus
    assert rows(queries.op2_exact_dedup(spark, sf)) == sorted(brute.exact(docs))


def test_token_files(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    sf, docs, _, _ = corpus
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert rows(queries.op3_token_files(spark, sf)) == sorted(brute.token_rows(docs, t))


def test_token_counts(spark, corpus):
    """Tokens by the library, and the ends that a scan of the unindexed files finds again."""
    import public_tokenizers
    from tokenizers import Tokenizer

    sf, docs, _, _ = corpus
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for d, x in docs}
    got = queries.op9_token_counts(spark, sf).collect()
    assert len(got) == len(docs) and all(r["n_tokens"] == r["n_indexed"] == want[r["doc_id"]] and r["ended"] for r in got)


def test_ngram_join(spark, corpus):
    sf, docs, _, _ = corpus
    links, classes = brute.links(docs)
    assert max(links.values()) > 10
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op10_ngram_join(spark, sf).collect()}
    assert got == {d: (classes[d], links[d]) for d in links}


def test_mixing(spark, corpus):
    sf, _, _, docs = corpus
    got = {r["doc_id"]: r for r in queries.op6_mixing(spark, sf).collect()}
    none = lambda x: "(none)" if x is None else x
    cells = Counter()
    for d in docs:
        r = got[d[0]]
        assert (r["source"], r["lang"]) == (none(d[3]), none(d[2]))
        assert r["tokens"] == len(brute.pieces(d[1]))
        cells[r["source"], r["lang"], r["topic"]] += r["tokens"]
    cells = {k: v for k, v in cells.items() if v}
    w, total = dict(cells), sum(cells.values())
    own = [Counter(), Counter(), Counter()]
    for k, v in cells.items():
        for m in range(3):
            own[m][k[m]] += v
    goal = {k: v * own[0][k[0]] ** -0.2 * own[1][k[1]] ** -0.2 * own[2][k[2]] ** -0.05 for k, v in cells.items()}
    tempered = sum(goal.values())
    for _ in range(500):
        for m in range(3):
            sums, now = Counter(), Counter()
            for k, v in cells.items():
                sums[k[m]] += goal[k]
                now[k[m]] += w[k]
            w = {k: v * total * sums[k[m]] / tempered / now[k[m]] for k, v in w.items()}
    most = max(w[k] / cells[k] for k in cells)
    for r in got.values():
        k = r["source"], r["lang"], r["topic"]
        p = w[k] / cells[k] / most if k in cells else 1.0
        assert r["probability"] == pytest.approx(p, abs=2e-6)
        u = int(hashlib.md5(f"mix-{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        assert r["sampled"] == (u < p)


def test_url_filter(spark, tmp_path):
    urls = ["http://a.EXAMPLE.net/en/1", "https://example.net/de", "http://xexample.net/en/", "http://example.com/de/x?y#z", "http://m.example.com/en/", "ftp://sub.org/fr/", "https://org/fr", "no scheme", None, "", "http://net", "http://NET/", "http://u:p@example.net:80/en/", "http://example.net?x=/en/", "http://org.net/fr/ünï#://", "x://y://z.net/"]
    sf = write(spark, tmp_path, pages=([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string"))
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for r in queries.op7_url_filter(spark, sf).collect():
        url = urls[r["page_id"]] or ""
        rest = url.partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [k for k in rules for name, _, p in [k.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + p)]
        rule = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == rules[rule] if rule else r["verdict"] in ("allow", "block")


def test_html_text(spark, tmp_path):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li><a href=x>One</a></li></ul></nav>"
        "<div class='ad'>Buy it now or never</div><article><h1>A &amp; B</h1><p>First <b>par</b>agraph  of\nthe text<br>goes on &#233; here.</p><aside>Read more of it</aside>"
        "<p>Second one &lt;with&gt; signs and words</p><form>Mail <input></form><div class='comments'><p>Nice work, really nice work by all of you</p></div></article>"
        "<div class='sidebar'><p>Other things</p></div><footer>&copy; all</footer></body></html>"
    )
    pages = [(0, "u", page), (1, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", page[: page.index("</article>")]), (5, "u", "<article><p>Only words</p></article>"), (6, "u", page), (7, "u", "<nav>menu</nav>")]
    sf = write(spark, tmp_path, pages=(pages, "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in queries.op8_html_text(spark, sf).collect()}
    want = "A & B First paragraph of the text goes on é here. Second one <with> signs and words"
    assert {k: r["text"] for k, r in got.items()} == {0: want, 1: "", 2: "", 3: "", 4: want, 5: "Only words", 6: want, 7: ""}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_html_text_of_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["page_id"]: r["text"] for r in queries.op8_html_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)[^>]*>", body)]
        assert got[r["page_id"]] == " ".join(b for b in blocks if b)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op4_toxicity(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got["held_out"].items())
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()
    y = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    both = got[got["held_out"]].join(y, how="inner")
    hit = (both["predicted"] == 1) & (both["toxic"] == 1)
    assert hit.sum() / (both["toxic"] == 1).sum() > 0.8 and hit.sum() / both["predicted"].sum() > 0.7


def test_chat_roles_held_out(spark):
    """Every line of every turn has a role and is rendered; roles of unseen conversations are mostly right."""
    sf = "/root/testdata/sf0.01"
    turns = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = queries.op5_chat_format(spark, sf).collect()
    lines = [(c, t, x) for (c, t), r in turns.items() for x in re.split("\r\n|\n|\r", r["text"] or "") if x.strip(" ")]
    assert len(got) == len(lines) and {(r["conv_id"], r["turn"]) for r in got} == {(c, t) for c, t, _ in lines}
    assert sorted(r["rendered"].split("|>\n")[-1].strip() for r in got) == sorted(x.strip() for *_, x in lines)  # markers are gone
    held = [r["role"] == turns[r["conv_id"], r["turn"]]["role"] for r in got if zlib.crc32(str(r["conv_id"]).encode()) % 4 == 2]
    assert np.mean(held) > 0.85
    assert all((f"<|{r['role']}|>\n" in r["rendered"]) == r["opens"] for r in got)
