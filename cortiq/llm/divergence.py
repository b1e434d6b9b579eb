"""How far sources of a language differ in their words: distances between sources, and the terms that stand out in each.

1. Every task counts terms by (lang, source) in a bounded dictionary; the partial counts are then summed by key. A language
   keeps the terms that enough of its documents have.
2. `terms`: a group's kept terms fall into buckets by their count in the group, so a bucket has one probability p. The
   smallest probability q that the language gives any term of the bucket bounds what the bucket can hold: f <= p - min q.
   Buckets are evaluated best bound first until TOP positive values are known; the least of these TOP values is a floor,
   and only buckets whose bound is not strictly below it are evaluated besides. No unseen term can then take part.
3. `pairs`: with b the probability of a term that a source does not have, the distance of two sources is
   V |b1 - b2|, plus for each of both the sum over its own count buckets of |p - b'| - |b - b'|, plus over the terms that
   both have |p1 - p2| - |p1 - b2| - |b1 - p2| + |b1 - b2|. Only the last sum needs postings (a term's sources); tasks add it
   up by pairs of sources and never send a row for a term and a pair.

Probabilities are integers and all arithmetic is exact; counts are divided as decimals, so no corpus is too large.

Defined results: a null text has no terms; null languages and sources count as ''; a language's documents are its rows, so
rows that repeat an id are documents of their own; a group without kept terms still has its pairs and, of course, no terms; a
language with one source has no pairs; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import small_or_not, written

#: A term is kept in a language if so many of its documents have it; counts are smoothed by PRIOR; p are parts of SCALE.
LEAST_DOCS, PRIOR, SCALE = 30, 5, 1_000_000_000
#: Ranks of a group's terms.
TOP = 50
#: Terms that a task counts before it sends them on.
TASK_TERMS = 200_000
#: Pairs of postings that a task expands at a time, and pairs of sources that it adds up before it sends them on.
EXPAND, TASK_PAIRS = 500_000, 500_000

#: Bytes of UTF-8: A-Z lower-cased; a-z and bytes from 0x80 kept; all others separate terms.
_TERMS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
GROUP = ("lang", "source")


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, source, term, n, docs); a group without terms sends a null term."""
    tallies: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in tallies.items():
            keys = [*docs, None]
            for i in range(0, len(keys), 50_000):
                some = keys[i : i + 50_000]
                names = pa.array(some, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some)), "source": pa.array([source] * len(some)), "term": names, "n": pa.array([n[k] for k in some], pa.int64()), "docs": pa.array([docs[k] for k in some], pa.int64())})
        tallies.clear()

    held = 0
    for batch in batches:
        for text, lang, source in zip(*(batch.column(c) for c in ("text", *GROUP)), strict=True):
            n, docs = tallies.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, words = len(docs), terms_of(text.as_py())
            n.update(words)
            docs.update(set(words))
            held += len(docs) - before
            if held > TASK_TERMS:
                yield from sent()
                held = 0
    yield from sent()


def counted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of every group and term, as a table; each group has a row with a null term as well."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", *GROUP)])
    parts = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return written(spark, parts.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def probability(n: str, total: str, kept: str) -> F.Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR kept)), by whole division of decimals."""
    return F.expr(f"1 + ({SCALE}BD * CAST({n} + {PRIOR} AS DECIMAL(19, 0))) DIV CAST({total} + {PRIOR} * {kept} AS DECIMAL(19, 0))")


class Audit:
    """The counts of a corpus by language and source, and what follows from them."""

    def __init__(self, spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS):
        self.spark = spark
        found = counted(spark, docs)
        kept = found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
        kept = written(spark, kept.select("lang", "term", "lang_n"), "kept-terms")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
        groups = found.select(*GROUP).distinct()
        cells = found.where("term IS NOT NULL").join(kept, ["lang", "term"])
        sizes = cells.groupBy(*GROUP).agg(F.sum("n").alias("total"))
        groups = groups.join(sizes, list(GROUP), "left").join(langs, "lang", "left").select(*GROUP, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")])
        numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row for each source
        groups = groups.withColumn("no", numbered)
        #: (lang, source, no, total, v, lang_total, base): base is the probability of a kept term that the group lacks.
        self.groups = written(spark, groups.withColumn("base", F.when(F.col("v") > 0, probability("0", "total", "v"))), "term-groups")
        known = cells.join(small_or_not(self.groups), list(GROUP))
        #: (lang, source, no, term, n, p, q, base) of each kept term that a group has.
        self.cells = written(spark, known.select(*GROUP, "no", "term", "n", probability("n", "total", "v").alias("p"), probability("lang_n", "lang_total", "v").alias("q"), "base"), "term-cells")

    def buckets(self) -> DataFrame:
        """(lang, source, n, p, terms, least_q, most_q): a group's kept terms by their count."""
        return self.cells.groupBy(*GROUP, "n").agg(F.first("p").alias("p"), F.count(F.lit(1)).alias("terms"), F.min("q").alias("least_q"), F.max("q").alias("most_q"))

    def evaluated(self, chosen: DataFrame) -> DataFrame:
        """(lang, source, item, value) of the terms with p > q in the chosen buckets (lang, source, n), rows of a written table."""
        return self.cells.join(small_or_not(chosen), [*GROUP, "n"]).where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank) of each group's terms of the largest p - q, up to `top`."""
        bound, group = F.col("p") - F.col("least_q"), Window.partitionBy(*GROUP)
        bounded = self.buckets().where("p > least_q").withColumn("bound", bound)
        best = group.orderBy(F.desc("bound"), "n")
        # Terms that surely count in the buckets of better bounds: all of a bucket if its largest q is below p, else one.
        sure = F.when(F.col("p") > F.col("most_q"), F.col("terms")).otherwise(F.lit(1))
        known = F.coalesce(F.sum(sure).over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ordered = written(self.spark, bounded.withColumn("known", known).select(*GROUP, "n", "bound", "known"), "term-buckets")
        first = written(self.spark, self.evaluated(ordered.where(F.col("known") < top).select(*GROUP, "n")), "first-terms")
        place = F.row_number().over(group.orderBy(F.desc("value"), "item"))
        floors = first.withColumn("place", place).where(F.col("place") <= top).groupBy(*GROUP).agg(F.when(F.count(F.lit(1)) == top, F.min("value")).alias("floor"))
        unseen = ordered.where(F.col("known") >= top).join(floors, list(GROUP), "left").where(F.coalesce(F.col("bound") >= F.col("floor"), F.lit(True)))
        unseen = written(self.spark, unseen.select(*GROUP, "n"), "more-buckets")
        both = first.unionByName(self.evaluated(unseen))
        return both.withColumn("rank", place).where(F.col("rank") <= top)

    def common(self) -> DataFrame:
        """(lang, one, two, extra) for one < two: what the terms that both sources have add to their distance."""
        postings = self.cells.groupBy("lang", "term").agg(F.collect_list(F.struct("no", "p", "base")).alias("has")).where("size(has) > 1")  # a struct for each source of the term
        return postings.select("lang", "has").mapInArrow(_common, "lang string, one int, two int, extra long").groupBy("lang", "one", "two").agg(F.sum("extra").alias("extra"))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): the distance of each source to each other of its language, the largest first."""
        own = self.groups.select("lang", "source", "no", "v", "base")
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("no").alias("other_no"), F.col("base").alias("other_base"))
        pairs = own.join(other, "lang").where("no <> other_no")
        apart = F.abs(F.col("base") - F.col("other_base"))
        # A source's own terms, as if the other had none of them: by count buckets, not by terms.
        alone = self.buckets().join(own, list(GROUP)).join(other, "lang").where("no <> other_no")
        alone = alone.groupBy("lang", "no", "other_no").agg(F.sum(F.col("terms") * (F.abs(F.col("p") - F.col("other_base")) - apart)).alias("alone"))
        turned = alone.select("lang", F.col("no").alias("other_no"), F.col("other_no").alias("no"), F.col("alone").alias("other_alone"))
        common = self.common()
        common = common.unionByName(common.select("lang", F.col("two").alias("one"), F.col("one").alias("two"), "extra")).withColumnsRenamed({"one": "no", "two": "other_no"})
        key = ["lang", "no", "other_no"]
        joined = pairs.join(alone, key, "left").join(turned, key, "left").join(common, key, "left")
        value = F.coalesce(F.col("v") * apart, F.lit(0))
        for c in ("alone", "other_alone", "extra"):
            value = value + F.coalesce(F.col(c), F.lit(0))
        place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
        return joined.select(*GROUP, "item", value.alias("value")).withColumn("rank", place)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by (lang, one, two), with one < two, over this task's postings."""
    sums: dict[str, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    held = 0

    def folded(keys: list[np.ndarray], extras: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, np.concatenate(extras))
        return [found], [total]

    def sent(lang: str) -> pa.RecordBatch:
        (key,), (total,) = folded(*sums.pop(lang))
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(key)), "one": pa.array(key >> 32, pa.int32()), "two": pa.array(key & 0xFFFFFFFF, pa.int32()), "extra": pa.array(total, pa.int64())})

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        has = batch.column("has")
        offsets = has.offsets.to_numpy()
        flat = has.values
        no, p, base = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("no", "p", "base"))
        for lang in set(langs.tolist()):
            rows = np.flatnonzero(langs == lang)
            left, ends = [], []
            for r in rows:  # each posting but the last of a term meets those after it
                left.append(np.arange(offsets[r], offsets[r + 1] - 1))
                ends.append(np.full(offsets[r + 1] - 1 - offsets[r], offsets[r + 1]))
            left, ends = np.concatenate(left), np.concatenate(ends)
            reach = ends - left - 1
            cuts = np.searchsorted(np.cumsum(reach), np.arange(EXPAND, reach.sum() + EXPAND, EXPAND)) + 1
            for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
                some, n = left[a:b], reach[a:b]
                i = np.repeat(some, n)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                extra = np.abs(p[i] - p[j]) - np.abs(p[i] - base[j]) - np.abs(base[i] - p[j]) + np.abs(base[i] - base[j])
                keys, extras = sums.setdefault(lang, ([], []))
                keys.append(np.minimum(no[i], no[j]) << 32 | np.maximum(no[i], no[j]))
                extras.append(extra)
                sums[lang] = folded(keys, extras)
                held = sum(len(k) for ks, _ in sums.values() for k in ks)
                if held > TASK_PAIRS:
                    yield sent(lang)
    for lang in list(sums):
        yield sent(lang)


def divergence(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has the other sources of the language, part `term` the group's terms."""
    audit = Audit(spark, docs, least_docs)
    return audit.pairs().withColumn("part", F.lit("pair")).unionByName(audit.terms(top).withColumn("part", F.lit("term"))).select(*GROUP, "part", "item", "value", "rank")


def oracle(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    p = lambda n, total: f"1 + ({SCALE} * ({n} + {PRIOR})) // ({total} + {PRIOR} * v)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row_no, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT row_no) >= {least_docs}),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS lang_total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM counts GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "coalesce(t.total, 0)")} AS p, {p("lang_n", "lang_total")} AS q
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
    LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p))::BIGINT AS value FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) d
    ON a.lang = d.lang AND a.source = d.source AND b.source = d.other
  UNION ALL SELECT lang, source, 'term', term, p - q FROM grid WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {top}
"""
