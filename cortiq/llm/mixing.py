"""Mixing sources to target weights: iterative proportional fitting of token weights to source, language and topic
marginals, then sampling of documents by the calibrated probabilities; DataFrame operations only.

Documents are reduced to cells (source, language, topic) by partial aggregation, so a source of any share sends a row a
task. Raking multiplies the cells' weights by target / sum over one marginal after the other, until every marginal is
within TOLERANCE; targets that the cells cannot meet raise an error. The cells are one row of arrays for that, or, where
there are more than ONE_ROW of them, a table with a join a step. A document's probability is its cell's weight over its
tokens, scaled so that the largest is 1; it is sampled when a hash of its id, as a number in [0, 1), is below that.

Without given targets, they are the marginals of the cells' tokens, each times its source's, its language's and its topic's tokens to
the power TEMPER - 1: small sources, languages and topics gain, topics least, as a text's topic is a guess. The same cells can meet
these targets by construction; a user's own may ask for anything that cells can meet.

Defined results: null source, language or topic is a value of its own, `(none)`; null and empty texts have no tokens and
keep their cell's probability; a cell without tokens has probability 1; rows that repeat an id are sampled alike (if in
one cell); null ids hash as empty strings; an empty table gives no rows. Target values that no document with tokens has
are left out and the others scaled up; values that a given marginal lacks get no weight. Further columns are kept by
`mixed_documents`, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import observed, small_or_not, written

MARGINALS = ("source", "lang", "topic")
#: Without given targets, the values of a marginal count by their tokens to this power.
TEMPER = {"source": 0.8, "lang": 0.8, "topic": 0.95}
#: Rounds between two looks at the error, the largest error as a share of all tokens, and the share of an error that must be left
#: after a look at most: else the targets cannot be met, and an error is raised.
BATCH, TOLERANCE, STALLED = 40, 1e-10, 0.999
#: Up to so many cells are raked as one row of arrays.
ONE_ROW = 2_000
#: Signs of topics in a text, found in one pass, and which of them speak for each topic; stems of license texts.
#: A text's topic is the one with the most signs, if there is one for each SHARE tokens; prose otherwise, the first of equals.
SIGNS = "[!-/:-@\\[-`{-~]{3,}|@[A-Za-z0-9-]+[.][A-Za-z]|[0-9]{3}[ .-][0-9]{2,4}|[0-9]+|[;{}=<>|]"
TOPICS = {"contact": "^@[A-Za-z0-9]|^[0-9]+[ .-]", "code": "^[;{}=<>]$", "table": "^[|0-9][0-9]*$", "noise": "^[^0-9A-Za-z\\n]{3,}$"}
LICENSE = ("icens", "opyright", "arrant", "ermission", "iabilit")
SHARE = 25
#: Letters, which a run at a time is first cut to one `a`; white space; and the pieces of that, which byte-level
#: tokenizers cut first - a run of letters, of digits, or of other signs.
LETTERS, SPACE = "[A-Za-z\\x{80}-\\x{10FFFF}]+", " \\t\\n\\r\\f"
PIECES = f"a|[0-9]+|[^{SPACE}0-9a]+"


def shortened(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), LETTERS, "a")


def tokens_in(short: Column) -> Column:
    """The pieces in a shortened text: a count of tokens by native functions. A table's own counts can be given instead."""
    return F.length(F.regexp_replace(F.regexp_replace(short, f"(?:{PIECES})[{SPACE}]*", "x"), f"^[{SPACE}]+", "")).cast("long")


def with_topic(docs: DataFrame, name: str, short: str, tokens: str) -> DataFrame:
    """docs with a column of that name: the topic of text, whose shortened form and tokens are there. Steps are columns of their own, so that each is computed once."""
    mark, text = uuid.uuid4().hex, F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = [f"n{i}_{mark}" for i in range(1 + len(TOPICS))]
    stems = [F.length(text) - F.length(F.replace(text, F.lit(w), F.lit(w[:-1]))) for w in LICENSE]
    found = docs.withColumns({f"signs_{mark}": F.array_join(F.regexp_extract_all(F.col(short), F.lit(f"(?=[^a ])(?:{SIGNS})"), F.lit(0)), "\n"), n[0]: sum(stems[1:], stems[0])})
    found = found.withColumns({k: F.regexp_count(F.col(f"signs_{mark}"), F.lit(f"(?m){p}")) for k, p in zip(n[1:], TOPICS.values(), strict=True)})
    found = found.withColumn(f"most_{mark}", F.greatest(*n))
    most = F.col(f"most_{mark}")
    topic = F.when((most == 0) | (most * SHARE < F.col(tokens)), F.lit("prose"))
    for k, value in zip(n, ("license", *TOPICS), strict=True):
        topic = topic.when(F.col(k) == most, F.lit(value))
    return found.withColumn(name, topic).drop(f"signs_{mark}", f"most_{mark}", *n)


def uniform(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from 52 bits of a digest of the id."""
    key = F.concat(F.lit(seed + "-"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def keyed(docs: DataFrame, names: dict[str, str], topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """docs with the three marginals without nulls, and tokens, under the given names."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    docs = docs.withColumn(short := f"short_{uuid.uuid4().hex}", shortened(F.col("text").cast("string")))
    docs = docs.withColumn(names["tokens"], F.coalesce(tokens_in(F.col(short)) if tokens is None else tokens.cast("long"), F.lit(0)))
    docs = with_topic(docs, names["topic"], short, names["tokens"]) if topic is None else docs.withColumn(names["topic"], none(topic))
    return docs.withColumns({names["source"]: none(F.col("source")), names["lang"]: none(F.col("lang"))}).drop(short)


def _targets(spark: SparkSession, cells: DataFrame, targets: dict[str, dict[str, float]], temper: dict[str, float]) -> DataFrame:
    """(marginal, value, share): what each marginal's values with tokens shall have."""
    tempered = cells.withColumn("t", F.col("tokens").cast("double"))
    for m in MARGINALS:
        tempered = tempered.join(cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper[m] - 1)).alias("f")), m).withColumn("t", F.col("t") * F.col("f")).drop("f")
    values = F.array(*[F.struct(F.lit(m).alias("marginal"), F.col(m).alias("value"), "t") for m in MARGINALS])
    sums = tempered.select(F.inline(values)).groupBy("marginal", "value").agg(F.sum("t").alias("share"))
    for m in MARGINALS:
        if m in targets:
            known = F.create_map(*[x for k, v in targets[m].items() for x in (F.lit(k), F.lit(float(v)))])
            sums = sums.withColumn("share", F.when(F.col("marginal") == m, F.coalesce(F.try_element_at(known, F.col("value")), F.lit(0.0))).otherwise(F.col("share")))
    of = [F.sum(F.when(F.col("marginal") == m, F.col("share"))).alias(m) for m in MARGINALS]
    sums, totals = observed(spark, sums, "targets", *of)
    for m in MARGINALS:
        if not totals[m]:
            raise ValueError(f"no document with tokens has a {m} among its targets")
    total = F.create_map(*[x for m in MARGINALS for x in (F.lit(m), F.lit(totals[m]))])
    return sums.withColumn("share", F.col("share") / F.element_at(total, F.col("marginal")))


def _as_row(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: w, the cells' shares; for each marginal its values' targets t_, the cells of each value in_, and each cell's value at_."""
    cells = cells.select(F.row_number().over(Window.orderBy(*MARGINALS)).alias("i"), *MARGINALS, F.col("tokens").cast("double").alias("w"))
    row = cells.agg(F.sum("w").alias("total"), F.array_sort(F.collect_list(F.struct("i", *MARGINALS, "w"))).alias("cells"))
    row = row.select("cells", F.transform("cells", lambda c: c["w"] / F.col("total")).alias("w"))
    goals = targets.agg(F.array_sort(F.collect_list(F.struct("marginal", "value", "share"))).alias("goals"))
    row = row.crossJoin(goals)  # one row by one row
    for m in MARGINALS:
        row = row.withColumn(f"all_{m}", F.filter("goals", lambda g: g["marginal"] == m))
        row = row.withColumn(f"t_{m}", F.transform(f"all_{m}", lambda t: t["share"]))
        row = row.withColumn(f"in_{m}", F.transform(f"all_{m}", lambda t: F.transform(F.filter("cells", lambda c: c[m] == t["value"]), lambda c: c["i"])))
        row = row.withColumn(f"at_{m}", F.transform("cells", lambda c: F.array_position(F.transform(f"all_{m}", lambda t: t["value"]), c[m]).cast("int"))).drop(f"all_{m}")
    return row.drop("goals")


def _sums(w: Column, m: str) -> Column:
    return F.transform(F.col(f"in_{m}"), lambda cells: F.aggregate(cells, F.lit(0.0), lambda a, i: a + F.element_at(w, i)))


def _step(w: Column, m: str) -> Column:
    """w after one marginal's step. The factors are bound by a one-element array, so that they are computed once."""
    factors = F.zip_with(F.col(f"t_{m}"), _sums(w, m), lambda t, s: F.when(s > 0, t / s).otherwise(F.lit(0.0)))
    return F.element_at(F.transform(F.array(factors), lambda f: F.zip_with(w, F.col(f"at_{m}"), lambda x, k: x * F.element_at(f, k))), 1)


def _nearer(before: float, worst: float) -> float:
    """The error now, if it still falls."""
    if worst > STALLED * before:
        raise ValueError(f"targets cannot be met: a marginal stays off by {worst:.3g} of all tokens")
    return worst


def _raked_row(spark: SparkSession, cells: DataFrame, targets: DataFrame) -> DataFrame:
    row = _as_row(cells, targets)

    def round_of(w: Column, _: Column) -> Column:
        for m in MARGINALS:
            w = F.element_at(F.transform(F.array(w), lambda x: _step(x, m)), 1)
        return w

    before = float("inf")
    while True:
        row = written(spark, row.withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(BATCH)), F.col("w"), round_of)), "raked")
        errors = [F.array_max(F.zip_with(F.col(f"t_{m}"), _sums(F.col("w"), m), lambda t, s: F.abs(t - s))) for m in MARGINALS]
        worst = row.select(F.greatest(*errors)).first()[0]
        if worst <= TOLERANCE:
            return row.select(F.inline(F.zip_with("cells", "w", lambda c, w: F.struct(*[c[m].alias(m) for m in MARGINALS], w.alias("weight")))))
        before = _nearer(before, worst)


def _raked_table(spark: SparkSession, cells: DataFrame, targets: DataFrame) -> DataFrame:
    total = float(cells.agg(F.sum("tokens")).first()[0])
    goals = {m: written(spark, targets.where(F.col("marginal") == m).select(F.col("value").alias(m), "share"), "targets") for m in MARGINALS}
    state = cells.select(*MARGINALS, (F.col("tokens") / total).alias("weight"))
    before = float("inf")
    while True:
        for m in MARGINALS:
            sums = state.groupBy(m).agg(F.sum("weight").alias("now"))
            factors = sums.join(goals[m], m).select(m, F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(F.lit(0.0)).alias("factor"))
            state = state.join(factors, m).select(*MARGINALS, (F.col("weight") * F.col("factor")).alias("weight"))
        state = written(spark, state, "raked")
        worst = max(state.groupBy(m).agg(F.sum("weight").alias("now")).join(goals[m], m).agg(F.max(F.abs(F.col("now") - F.col("share")))).first()[0] for m in MARGINALS)
        if worst <= TOLERANCE:
            return state
        before = _nearer(before, worst)


def raked(spark: SparkSession, cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] = TEMPER) -> DataFrame:
    """cells (marginals, tokens) with `weight`, shares of all tokens that meet the targets (shares of a marginal's values)."""
    cells, seen = observed(spark, cells.select(*MARGINALS, "tokens"), "cells", F.count_if(F.col("tokens") > 0).alias("live"))
    live, n = cells.where("tokens > 0"), seen["live"]
    if not n:
        return cells.withColumn("weight", F.lit(None).cast("double"))
    goals = _targets(spark, live, targets or {}, temper)
    state = (_raked_row if n <= ONE_ROW else _raked_table)(spark, live, goals)
    return cells.join(state, list(MARGINALS), "left")


def chances(spark: SparkSession, rows: DataFrame, names: dict[str, str], targets: dict[str, dict[str, float]] | None, temper: dict[str, float]) -> DataFrame:
    """(marginals, probability) of each cell of rows."""
    cells = rows.groupBy(*[F.col(names[m]).alias(m) for m in MARGINALS]).agg(F.sum(F.col(names["tokens"])).alias("tokens"))
    cells = raked(spark, cells, targets, temper)
    ratio = F.expr("try_divide(weight, tokens)").alias("ratio")
    cells, seen = observed(spark, cells.select(*MARGINALS, ratio), "ratios", F.max("ratio").alias("most"), F.count(F.lit(1)).alias("rows"))
    most = seen["most"] or 1.0
    return small_or_not(cells.select(*MARGINALS, F.coalesce(F.col("ratio") / float(most), F.lit(1.0)).alias("probability")), seen["rows"])


def calibrated(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, tokens: Column | None = None, temper: dict[str, float] = TEMPER) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, sampled) of each document."""
    names = {n: n for n in (*MARGINALS, "tokens")}
    rows = written(spark, keyed(docs, names, topic, tokens).select("doc_id", *names), "marginals")  # the texts are read once
    joined = rows.join(chances(spark, rows, names, targets, temper), list(MARGINALS))
    return joined.select("doc_id", *MARGINALS, "tokens", F.round("probability", 6).alias("probability"), (uniform(F.col("doc_id")) < F.col("probability")).alias("sampled"))


def mixed_documents(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, tokens: Column | None = None, temper: dict[str, float] = TEMPER) -> DataFrame:
    """The sampled documents, with all their columns; each row is sampled by its own cell, whatever rows share its id."""
    names = {n: f"{n}_{uuid.uuid4().hex}" for n in (*MARGINALS, "tokens")}
    rows = written(spark, keyed(docs, names, topic, tokens), "marginals")  # else filters on a topic would find it again
    chance = chances(spark, rows, names, targets, temper).withColumnsRenamed({m: names[m] for m in MARGINALS} | {"probability": (drawn := f"p_{uuid.uuid4().hex}")})
    joined = rows.join(chance, [names[m] for m in MARGINALS])
    return joined.where(uniform(F.col("doc_id")) < F.col(drawn)).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(rounds: int = 400) -> str:
    """SQL for calibrated() with its defaults; the cells are one row of lists, raked by recursion."""
    names = ("license", *TOPICS)
    stems = " + ".join(f"length(t) - length(replace(t, '{w}', '{w[:-1]}'))" for w in LICENSE)
    counts = f"{stems} AS n0, " + ", ".join(f"len(list_filter(s, lambda x: regexp_matches(x, '{p}'))) AS n{i}" for i, p in enumerate(TOPICS.values(), 1))
    most = f"greatest({', '.join(f'n{i}' for i in range(len(names)))})"
    which = " ".join(f"WHEN n{i} = {most} THEN '{n}'" for i, n in enumerate(names))
    index = ", ".join(f"list_transform(range(1, {'{n}'} + 1), lambda i: list_position(v_{m}, c[i].{m})) AS at_{m}" for m in MARGINALS).replace("{n}", "len(c)")
    shares = ", ".join(f"list_transform(v_{m}, lambda v: list_sum(list_transform(list_filter(c, lambda x: x.{m} = v), lambda x: x.t)) / z) AS t_{m}" for m in MARGINALS)
    members = ", ".join(f"list_transform(range(1, len(v_{m}) + 1), lambda k: list_filter(range(1, len(c) + 1), lambda i: at_{m}[i] = k)) AS in_{m}" for m in MARGINALS)
    sql = f"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS t, regexp_replace(t, '{LETTERS}', 'a', 'g') AS z, regexp_extract_all(z, '{SIGNS}') AS s FROM documents),
counts AS (SELECT doc_id, source, lang, len(regexp_extract_all(z, '{PIECES}')) AS tokens, {counts} FROM texts),
rows AS MATERIALIZED (SELECT doc_id, source, lang, tokens, CASE WHEN {most} = 0 OR {most} * {SHARE} < tokens THEN 'prose' {which} END AS topic FROM counts),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL HAVING sum(tokens) > 0),
tempered AS (SELECT *, tokens * {" * ".join(f"pow(sum(tokens) OVER (PARTITION BY {m}), {TEMPER[m] - 1})" for m in MARGINALS)} AS t FROM cells),
one AS (SELECT list({{'source': source, 'lang': lang, 'topic': topic, 'tokens': tokens, 't': t}} ORDER BY source, lang, topic) AS c, sum(tokens) AS total, sum(t) AS z,
  list(DISTINCT source) AS v_source, list(DISTINCT lang) AS v_lang, list(DISTINCT topic) AS v_topic FROM tempered),
two AS (SELECT *, {index} FROM one),
three AS MATERIALIZED (SELECT *, {shares}, {members} FROM two),
raking AS (SELECT 0 AS r, list_transform(c, lambda x: x.tokens / total) AS w FROM three UNION ALL
  SELECT r + 1, w3 FROM (
"""
    inner = "SELECT r, w AS w0 FROM raking"
    for k, m in enumerate(MARGINALS):
        factor = f"list_transform(range(1, len(v_{m}) + 1), lambda k: t_{m}[k] / list_sum(list_transform(in_{m}[k], lambda i: w{k}[i])))"
        inner = f"SELECT r, list_transform(range(1, len(c) + 1), lambda i: w{k}[i] * f{k}[at_{m}[i]]) AS w{k + 1} FROM (SELECT r, w{k}, {factor} AS f{k} FROM ({inner}), three), three"
    return sql + inner + f""") WHERE r < {rounds}),
last AS (SELECT c, w FROM raking, three WHERE r = {rounds}),
ratios AS (SELECT u.x.source AS source, u.x.lang AS lang, u.x.topic AS topic, u.p / max(u.p) OVER () AS p FROM
  (SELECT unnest(list_transform(range(1, len(c) + 1), lambda i: {{'x': c[i], 'p': w[i] / c[i].tokens}})) AS u FROM last))
SELECT doc_id, source, lang, topic, tokens, round(coalesce(p, 1.0), 6) AS probability,
  ('0x' || substr(md5('mix-' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < coalesce(p, 1.0) AS sampled
FROM rows LEFT JOIN ratios USING (source, lang, topic)
"""
