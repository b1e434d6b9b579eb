"""Main text of HTML by the maximum-scoring contiguous run of tokens, with weights from labelled pages.

A page becomes a sequence of tokens, words and tags. A word's weight is the log odds, among labelled pages, of words with
the same nearest enclosing block (element and class or id name) being content; a tag's weight is a constant cost plus
the log odds of that tag. One linear scan finds the run with the largest sum; the run is widened to whole blocks, and
boilerplate in it is left out. Boilerplate are the elements that HTML itself keeps for other things than a text (menus,
asides, footers, forms, scripts), headers that are not an article's own, and blocks whose names a logistic regression
holds for it: its features are the element and the words of its class, id and role, its examples the blocks inside and
outside the article of labelled pages. Boilerplate inside content - an <article>, a <main>, a kind of block that labelled
pages have only there, or any block with text of its own before and after - costs next to nothing, so that it does not
cut the run in two.

Labelled pages are the table's own pages with exactly one <article> or <main>, up to TRAIN_PAGES of them, besides
made-up layouts, so that layouts without such an element, and usual names, have weights too.

A page takes time in proportion to its length, whatever its tags: they are found by one pass without backtracking, and the
open elements carry what their descendants ask for.

Defined results: null, empty and unreadable pages give an empty text; an unclosed tag at the end is dropped; a `<` in a
tag is part of it; of runs of equal score the first and shortest is taken; rows that repeat a page, or its id, get the
results of their own html; null ids and urls stay null; further columns, whatever their names, are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_PAGES = 400
#: HTML's elements without content, elements that lay out as blocks, and elements whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript template iframe svg select button option noembed noframes canvas audio video".split())
#: Elements that hold the blocks of a text without being one.
HOSTS = frozenset("div section article main header center details".split())
#: Elements that are never main text.
NOT_MAIN = frozenset("nav footer aside form menu dialog head title script style noscript template iframe svg button select option textarea fieldset label input".split())
#: Comments and declarations, or a tag; nothing in it backtracks. A quote without its pair is an ordinary sign.
_TOKEN = re.compile(r"<!--(?:[^-]++|-(?!->))*+(?:-->)?|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S)
_NAME = re.compile(r"(?:^|\s)(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
_CLOSES = {"li": {"li"}, "p": BLOCKS, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WORD_COST, TAG_COST, BOUND, NESTED = 0.7, 0.15, 3.0, 0.02


def kind_of(name: str, attributes: str) -> str:
    """Element and names: `div.entry content`."""
    names = " ".join(a or b or c for a, b, c in _NAME.findall(attributes)) if attributes else ""
    return f"{name}.{re.sub('[0-9]+', '', names.lower())}" if names else name


def features_of(kind: str) -> tuple[str, list[str]]:
    """The element, and the words of its names."""
    name, _, names = kind.partition(".")
    return name, sorted(set(re.findall(r"[^\W\d_]+", names)))


class _Open:
    """An open element, with what its descendants ask for."""

    __slots__ = ("name", "block", "odd", "main", "host")

    def __init__(self, name: str, block: str, odd: int, main: bool, host: int):
        self.name, self.block, self.odd, self.main, self.host = name, block, odd, main, host

    def within(self, kind: str) -> str:
        return "*" + kind if self.main else kind


def tokens(page: str, weights: Weights | None = None) -> Iterator[tuple[str, str, int, str, bool, int]]:
    """(what, kind, not_main, text, breaks, host): what is tag, opening (the tag that opens boilerplate) or text; kind the
    tag's, or the text's nearest block's, after a `*` if an <article>, a <main> or a kind of content is around it.

    not_main is 1 for boilerplate, 2 for such inside an <article>, a <main> or a kind of content, else 0. host is the
    number of the host that a text stands in; 0 is the page itself.
    """
    root = _Open("", "", 0, False, 0)
    stack, count = [root], Counter()
    at = serial = 0

    def pop() -> _Open:
        top = stack.pop()
        count[top.name] -= 1
        return top

    while at < len(page):
        start = page.find("<", at)
        m = _TOKEN.match(page, start) if start >= 0 else None
        end = len(page) if start < 0 else start if m else start + 1
        if end > at:
            yield "text", stack[-1].within(stack[-1].block), stack[-1].odd, page[at:end], False, stack[-1].host
        at = m.end() if m else end
        name = (m[2] or "").lower() if m else ""
        if not name or not m[0].endswith(">"):
            continue
        if m[1]:
            odd = stack[-1].odd
            if count[name]:
                while (top := pop()).name != name:
                    pass
                odd = top.odd
            yield "tag", stack[-1].within("/" + name), odd, "", name in BLOCKS, 0
            continue
        while name in _CLOSES.get(stack[-1].name, ()):
            pop()
        if name in BLOCKS and count["p"]:
            # A block ends an open paragraph and the inline elements left open in it.
            while pop().name != "p":
                pass
        kind, top = kind_of(name, m[3]), stack[-1]
        odd, opening = top.odd, False
        if not odd and (name in NOT_MAIN or name == "header" and not top.main or weights and weights.boilerplate(kind)):
            odd, opening = 2 if top.main else 1, True
        yield "opening" if opening else "tag", top.within(kind), odd, " " if name == "br" else "", name in BLOCKS, 0
        if name in VOID or m[0].endswith("/>") and name not in BLOCKS:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*+>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        serial += 1
        main = top.main or name in ("article", "main") or bool(weights and kind in weights.content)
        stack.append(_Open(name, kind if name in BLOCKS else top.block, odd, main, serial if name in HOSTS else top.host))
        count[name] += 1


def labelled_counts(page: str, counts: Counter) -> None:
    """Add to counts[(what, kind, inside)] the tags and words of a page that has exactly one <article> or <main>."""
    lower = page.lower()
    for name in ("article", "main"):
        if len(re.findall(rf"<{name}[\s>]", lower)) == 1 and f"</{name}>" in lower:
            break
    else:
        return
    inside = False
    for what, kind, odd, text, *_ in tokens(page):
        kind = kind.removeprefix("*")
        if what == "tag" and kind.split(".")[0] == name:
            inside = True
        elif what == "tag" and kind == "/" + name:
            inside = False
        if odd:
            continue  # boilerplate by its element; it would only blur the weights of the same kinds elsewhere
        if what == "text":
            counts["text", kind, inside] += len(text.split())
        else:
            counts["tag", kind, inside] += 1


#: Names of blocks in the made-up layouts: in the article, and beside it.
WITHIN = "content|post|entry-content|article-body|story|main|text|post-body|section|chapter|body|entry|description|summary|lead|intro|quote|figure|caption|note|table|code|highlight|box"
BESIDE = (
    "ad|ads|advert|advertisement|ad-slot|banner|promo|promotion|sponsored|sponsor|cookie-notice|cookies|consent|cookie-banner|notice|site-notice|alert|popup|modal|overlay|"
    "nav|navbar|navigation|menu|main-menu|breadcrumb|breadcrumbs|header|site-header|page-header|masthead|footer|site-footer|page-footer|contentinfo|sidebar|side|widget|complementary|"
    "share|share-buttons|social|social-links|related|related-posts|recommended|comments|comment|comment-list|reply|replies|respond|disqus|subscribe|newsletter|signup|login|"
    "search|search-form|pagination|pager|tags|copyright"
)


def made_up_pages() -> list[str]:
    """Layouts with one <article>, whose blocks have usual names of content and of what stands beside it."""
    line = "words of a sentence that goes on for a while and then ends"
    out = []
    for k, name in enumerate(WITHIN.split("|")):
        body = "".join(f"<p>{line}</p>" for _ in range(4)) + f"<h2>{line}</h2><ul><li>{line}</li></ul><blockquote>{line}</blockquote><pre>{line}</pre><table><tr><td>{line}</td></tr></table>"
        body = f"<div class='{name}'>{body}</div><p class='{name}'>{line}</p><section id='{name}'>{body}</section><div>{line}</div>"
        beside = "".join(f"<{e} class='{n}'><a>{n}</a> a few words</{e}>" for j, n in enumerate(BESIDE.split("|")) for e in (("div", "section", "ul")[(j + k) % 3], "div"))
        out.append(f"<html><body><header><a href='/'>home</a></header><article>{body}</article>{beside}<div>line</div></body></html>")
    return out


class Weights:
    """Weights of words by their block's kind and of tags by their kind; unseen kinds fall back to the element's name, then to a default."""

    def __init__(self, counts: Counter):
        self.values: dict[tuple[str, str], float] = {}
        for what in ("text", "tag"):
            inside, outside = ({k[1]: n for k, n in counts.items() if k[0] == what and k[2] is c} for c in (True, False))
            merged: dict[str, list[float]] = {}
            for kind in inside.keys() | outside.keys():
                for key in {kind, kind.split(".")[0]}:
                    x = merged.setdefault(key, [0.0, 0.0])
                    x[0] += inside.get(kind, 0)
                    x[1] += outside.get(kind, 0)
            for key, (x, y) in merged.items():
                odds = math.log(x + 1) - math.log(y + 1)
                odds = max(-BOUND, min(BOUND, odds))
                self.values[what, key] = WORD_COST + odds if what == "text" else -TAG_COST + min(0.0, odds)

        tags = {k for what, k, _ in counts if what == "tag" and "." in k and k.split(".")[0] in HOSTS}
        #: Kinds of hosts that labelled pages have in the article and not beside it.
        self.content = frozenset(k for k in tags if counts["tag", k, True] > 0 and not counts["tag", k, False])
        self.fit_names(counts)

    def fit_names(self, counts: Counter) -> None:
        """Logistic regression of lying in the article, for kinds of blocks: a weight for the element, and the mean weight of
        the words of its names, so that a word which is not known counts against those that are. Kinds weigh by the
        logarithm of their number."""
        rows = [(*features_of(k), inside, math.log1p(n)) for (what, k, inside), n in sorted(counts.items()) if what == "tag" and not k.startswith("/") and k.split(".")[0] in BLOCKS]
        index: dict[str, int] = {}
        at, of, share = [], [], []
        for i, (name, words, *_) in enumerate(rows):
            for key, value in [(f"<{name}", 1.0), *((w, 1 / len(words)) for w in words)]:
                at.append(i), of.append(index.setdefault(key, len(index))), share.append(value)
        at, of, share = np.array(at, int), np.array(of, int), np.array(share)
        y, n = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows])
        w, bias = np.zeros(len(index)), 0.0
        for _ in range(300):
            z = bias + np.bincount(at, w[of] * share, len(rows))
            g = n * (y - 1 / (1 + np.exp(-z)))
            w += 0.2 * (np.bincount(of, g[at] * share, len(index)) - 0.3 * w) / (1 + np.bincount(of, n[at] * share**2, len(index)))
            bias += 0.1 * (g.sum() - 0.3 * bias) / (1 + n.sum())
        self.names, self.bias = dict(zip(index, w.tolist(), strict=True)), float(bias)
        self.known: dict[str, bool] = {}

    def boilerplate(self, kind: str) -> bool:
        """Whether a block with names is more likely beside an article than in it; blocks without names are not judged by them."""
        found = self.known.get(kind)
        if found is None:
            name, words = features_of(kind)
            z = self.bias + self.names.get(f"<{name}", 0.0) + sum(self.names.get(w, 0.0) for w in words) / max(1, len(words))
            found = bool(words) and any(w in self.names for w in words) and z < 0
            if len(self.known) < 100_000:
                self.known[kind] = found
        return found

    def of(self, what: str, kind: str, odd: int) -> float:
        if odd:  # left out of the text anyway; inside content it should not cut the run in two
            return (-BOUND if what == "text" else -TAG_COST - 1) * (NESTED if odd == 2 else 1)
        if kind.startswith("*"):  # by the definition of the labels always content: the bounded log odds
            return WORD_COST + BOUND if what == "text" else -TAG_COST
        got = self.values.get((what, kind))
        if got is None:
            got = self.values.get((what, kind.split(".")[0]))
        return got if got is not None else (WORD_COST if what == "text" else -TAG_COST)


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest positive sum; (0, 0) if there is none."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best + 1e-12:
            best, found = total, (start, i + 1)
    return found


def between_text(found: list[tuple]) -> list[int]:
    """not_main of each token, 2 also for boilerplate that has text of one host before and after it.

    The page itself is such a host only if it holds at least half of the words, as lines around a layout's blocks don't.
    """
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    words: Counter = Counter()
    for i, (what, _, odd, text, _, host) in enumerate(found):
        if what == "text" and not odd and (n := len(text.split())):
            first.setdefault(host, i)
            last[host] = i
            words[host] += n
    if 2 * words[0] < words.total():
        last.pop(0, None)
    # A host is open from its first to its last text, so those between the two are around any token there.
    out, now, around = [], 1, 0
    for i, (what, _, odd, _, _, host) in enumerate(found):
        if what == "text" and host in last and first[host] != last[host]:
            around += (first[host] == i) - (last[host] == i)
        if what == "opening" and odd == 1:
            now = 2 if around else 1
        out.append(now if odd == 1 else odd)
    return out


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    found = list(tokens(page, weights))
    scores = [weights.of("text" if w == "text" else "tag", k, odd) * (len(t.split()) if w == "text" else 1) for (w, k, _, t, *_), odd in zip(found, between_text(found), strict=True)]
    start, end = best_run(scores)
    # Widen the run to whole blocks: back to the last break before it and on to the first break after it.
    while start > 0 and start < end and not found[start - 1][4]:
        start -= 1
    while end < len(found) and start < end and not found[end][4]:
        end += 1
    blocks, now = [], []
    for what, _, odd, text, breaks, _ in found[start:end]:
        if what != "text" and breaks:
            blocks.append("".join(now))
            now = []
        elif not odd:
            now.append(text)
    blocks.append("".join(now))
    kept = (" ".join(html.unescape(b).split()) for b in blocks)
    return " ".join(b for b in kept if b)


def learnt(pages: DataFrame) -> Weights:
    """Weights from at most TRAIN_PAGES labelled pages (those with the smallest hash) and the made-up layouts."""
    some = pages.select(F.col("html").cast("string").alias("html")).where("html IS NOT NULL").orderBy(F.xxhash64("html"), "html").limit(TRAIN_PAGES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                labelled_counts(page.as_py(), counts)
        yield pa.RecordBatch.from_pydict({"what": pa.array([k[0] for k in counts], pa.string()), "kind": pa.array([k[1] for k in counts], pa.string()), "inside": pa.array([k[2] for k in counts], pa.bool_()), "n": pa.array(list(counts.values()), pa.int64())})

    counts: Counter = Counter()
    for page in made_up_pages():
        labelled_counts(page, counts)
    for row in some.mapInArrow(count, "what string, kind string, inside boolean, n long").groupBy("what", "kind", "inside").agg(F.sum("n").alias("n")).collect():
        counts[row["what"], row["kind"], row["inside"]] += row["n"]
    return Weights(counts)


def extracted(spark: SparkSession, pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    shared = spark.sparkContext.broadcast(weights or learnt(pages))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), shared.value) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
