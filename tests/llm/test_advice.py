"""Corpus operators on inputs that the tables don't have."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from cortiq.llm import html_text, toxicity


INSIDE = {
    "aside": "<aside><p>{}</p></aside>",
    "advert": "<div class='advert'>{}</div>",
    "form": "<form><p>{}</p><input></form>",
    "notice": "<div class='cookie-notice'><div><p>{}</p></div></div>",
}
OUTSIDE = {
    "class": "<div class='content'>{}</div>",
    "unknown class": "<div class='xq-wrap'>{}</div>",
    "section": "<div class='xq'><section>{}</section></div>",
    "page": "{}",
    "article": "<article>{}</article>",
}


@pytest.mark.parametrize("inside", INSIDE)
@pytest.mark.parametrize("outside", OUTSIDE)
def test_boilerplate_does_not_cut_content(inside, outside):
    """A block of 150 words between paragraphs, and a closing paragraph of 8 words, on pages with and without <article>."""
    counts = html_text.Counter()
    for page in html_text.made_up_pages():
        html_text.labelled_counts(page, counts)
    weights = html_text.Weights(counts)
    first, second, last = (" ".join(f"{k}{i}" for i in range(n)) for k, n in (("a", 60), ("b", 40), ("z", 8)))
    block = INSIDE[inside].format(" ".join(f"x{i}" for i in range(150)))
    body = OUTSIDE[outside].format(f"<p>{first}</p>{block}<p>{second}</p>{INSIDE['advert'].format('buy now ' * 10)}<p>{last}</p>")
    around = "<header><p>My site</p></header><nav><ul><li>One</li><li>Two</li></ul></nav>", "<aside class='sidebar'><p>" + "other news " * 20 + "</p></aside><div>stray words</div><footer>all rights</footer>"
    got = html_text.main_text(f"<html><body>{around[0]}{body}{around[1]}</body></html>", weights)
    assert got == f"{first} {second} {last}"


def test_pipeline_rejects_by_language_and_keeps_columns(spark):
    """Of the raw documents exactly those below their language's threshold stay, with their own score columns."""
    sf = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    docs = raw.withColumn("score", F.lit("mine")).withColumn("toxic_in_lang", F.lit(7)).withColumn("score_0", F.lit(8))
    model = toxicity.train(raw, spark.read.parquet(f"{sf}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    want = {r["doc_id"] for r in raw.collect() if model.probability(np.array([scorer.logit(r["text"])]))[0] < model.thresholds.get(r["lang"] or "", model.thresholds.get("", 0.5))}
    out = corpus_pipeline.toxicity_stage(spark, docs, sf)
    assert out.columns == docs.columns
    got = out.collect()
    assert {r["doc_id"] for r in got} == want and 0 < len(want) < raw.count()
    assert {(r["score"], r["toxic_in_lang"], r["score_0"]) for r in got} == {("mine", 7, 8)}
