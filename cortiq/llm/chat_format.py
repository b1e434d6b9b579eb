"""Transcript parsing: a hidden Markov model recovers the role of each line, then turns are rendered canonically.

States are roles, each as the line that opens a turn and as one that goes on with it; a line's emission is the product of independent categorical features: the speaker marker at its start,
its length class, whether it asks, and its number of line breaks. Start, transition and emission counts come from
labelled lines by grouped counts over all of them (a few dozen rows), with pseudo-counts that tie markers to their role.

Lines are numbered by range partitions and counts of these, then decoded by Viterbi in blocks of BLOCK lines, so no task
gathers a conversation, whatever its line numbers are. A conversation of one block is decoded at once. For longer ones
each block first yields its max-plus transfer matrix (6 x 6: the best score from each state before it to each at its end). Matrices are multiplied FAN at a time, level by level, until one is left for a conversation; going down again, each
level fixes the states at the borders of its parts, and the blocks are decoded between fixed ends. The result is that of
one Viterbi pass.

Defined results: null texts are empty lines; lines of equal order are ordered by text; null line numbers come first; a
null conversation id is a conversation of its own; repeated rows are repeated lines. Ties between states go to the first
by ROLES. Without labelled lines all counts are the pseudo-counts. Empty tables give no rows. Columns beyond the ones
named are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import runs, written

ROLES = ("system", "user", "assistant")
#: Names that open a line as a speaker marker.
SPEAKERS = {"system": "system", "user": "user|human|customer|question|q", "assistant": "assistant|ai|bot|model|agent|answer|a"}
#: State 2 r opens a turn of role r, 2 r + 1 goes on with it.
STATES = 2 * len(ROLES)
#: Lines of a block, and matrices that are multiplied at a time.
BLOCK, FAN = 256, 256
#: Pseudo-counts of a marker where its own role opens and anywhere else, of every other value, and of steps that cannot be.
OWN, OTHER, FLAT, NEVER = 20.0, 0.01, 1.0, 1e-6
SIZES = {"marker": 4, "length": 16, "asks": 2, "breaks": 4}


def marker_pattern(role: str) -> str:
    names = SPEAKERS[role]
    return rf"(?i)^\s*(?:(?:<\||\[|\*\*)(?:{names})(?:\|>|\]|:?\*\*):?|#+ *(?:{names}) *(?::|\r?\n|$)|(?:{names}) ?[:>])\s*"


def symbols(text: Column) -> dict[str, Column]:
    """The features of a line, as small integers."""
    marker = F.lit(0)
    for i, role in enumerate(ROLES):
        marker = F.when(text.rlike(marker_pattern(role)), F.lit(i + 1)).otherwise(marker)
    return {
        "marker": marker,
        "length": F.least(F.floor(F.log2(F.length(text) + F.lit(1.0))), F.lit(SIZES["length"] - 1)).cast("int"),
        "asks": F.rtrim(text).endswith("?").cast("int"),
        "breaks": F.least(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(SIZES["breaks"] - 1)).cast("int"),
    }


#: How people write a speaker in a transcript; `{}` is one of the role's names.
STYLES = ("{}: ", "**{}:** ", "### {}\n", "<|{}|> ", "[{}] ")


def transcribed(turns: DataFrame, share: float = 0.8) -> DataFrame:
    """turns (conv_id, turn, role, text) as a plain transcript: in a share of the turns, chosen by a hash, the text begins with a
    speaker marker, in the style and by the names that the conversation's hash chooses; the others have none."""
    pick = lambda n, *of: F.pmod(F.xxhash64(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), *of), F.lit(n))
    name = F.lit(None).cast("string")
    for role in ROLES:
        names = [n for n in SPEAKERS[role].split("|") if len(n) > 1]
        chosen = F.element_at(F.array(*[F.lit(n.capitalize()) for n in names]), (pick(len(names), F.lit("name")) + 1).cast("int"))
        name = F.when(F.col("role") == role, chosen).otherwise(name)
    marker = F.lit("")
    for i, style in enumerate(STYLES):
        before, after = style.split("{}")
        marker = F.when(pick(len(STYLES), F.lit("style")) == i, F.concat(F.lit(before), name, F.lit(after))).otherwise(marker)
    marked = pick(1000, F.coalesce(F.col("turn"), F.lit(-1)), F.lit("marked")) < int(1000 * share)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return turns.withColumn("text", F.when(marked & name.isNotNull(), F.concat(marker, text)).otherwise(text))


def lines_of(transcripts: DataFrame, keep: tuple[str, ...] = ("conv_id",), text: str = "text") -> DataFrame:
    """(keep, line_no, text) of the lines of transcripts, or parts of them, that are not blank. A speaker marker on a line of its
    own is put before the next line."""
    names = "|".join(SPEAKERS.values())
    alone = rf"(?im)^[ \t]*((?:<\||\[|\*\*)(?:{names})(?:\|>|\]|:?\*\*)|#+ *(?:{names})|(?:{names})(?=:)):?[ \t]*\r?\n"
    whole = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), alone, "$1: ")
    parts = transcripts.select(*keep, F.posexplode(F.split(whole, r"\r\n|\n|\r")).alias("line_no", "text"))
    return parts.where(F.trim("text") != "").select(*keep, F.col("line_no").cast("long").alias("line_no"), "text")


def numbered(lines: DataFrame, order: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
    """(key, rank, conv_id, order, more, text): lines of a conversation counted from 0 in their order.

    Rows are range-partitioned by conversation and order, down to repeated rows, so no partition holds a conversation; a
    line's rank is its place in its partition plus the counts of the partitions before.
    """
    spark = lines.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = lines.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("\0null")).alias("key"), "conv_id", *[F.col(c).cast("long").alias(c) for c in order], *more, text)
    by = ("key", *[F.col(c).asc_nulls_first() for c in order], "text", "tie")
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).drop("tie")
    rows = written(spark, rows.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "lines")
    counts = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    # A row for each conversation and partition: the partitions bound this window, not the lines.
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("key", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(shifts, ["key", "part"]).select("key", (F.col("place") + F.col("shift")).alias("rank"), "conv_id", *order, *more, "text")


def learnt(labelled: DataFrame, order: tuple[str, ...] = ("line_no",)) -> dict[str, np.ndarray]:
    """Log probabilities from (conv_id, order, text, role): start, transitions and one table for each feature."""
    rows = numbered(labelled, order, ("role",)).select("key", "rank", "role", *[v.alias(k) for k, v in symbols(F.col("text")).items()])
    rows = written(labelled.sparkSession, rows, "labelled-lines")
    known = rows.where(F.col("role").isin(*ROLES))
    role = np.arange(STATES) // 2
    opens = np.arange(STATES) % 2 == 0
    step = np.where(opens[None, :] == (role[:, None] != role[None, :]), FLAT, NEVER)
    model = {"start": np.where(opens, FLAT, NEVER), "step": step} | {k: np.full((STATES, n), FLAT) for k, n in SIZES.items()}
    model["marker"][:, 1:] = np.where(opens[:, None] & (role[:, None] == np.arange(len(ROLES))), OWN, OTHER)
    # Neighbours by an equi-join on the next number, not by a window over a conversation.
    before = known.select("key", (F.col("rank") + 1).alias("rank"), F.col("role").alias("before"))
    index = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) * 2 - 2
    states = known.join(before, ["key", "rank"], "left").withColumn("state", (index + F.col("before").eqNullSafe(F.col("role")).cast("int")).cast("int"))
    states = written(labelled.sparkSession, states.select("key", "rank", "state", *SIZES), "states")
    for row in states.groupBy("state", *SIZES).count().collect():  # at most 6 x 4 x 16 x 2 x 4 rows
        for k in SIZES:
            model[k][row["state"], row[k]] += row["count"]
    for row in states.where("rank = 0").groupBy("state").count().collect():
        model["start"][row["state"]] += row["count"]
    after = states.select("key", (F.col("rank") - 1).alias("rank"), F.col("state").alias("next"))
    for row in states.select("key", "rank", "state").join(after, ["key", "rank"]).groupBy("state", "next").count().collect():
        model["step"][row["state"], row["next"]] += row["count"]
    return {k: np.log(v / v.sum(axis=-1, keepdims=True)) for k, v in model.items()}


def emissions(model: dict[str, np.ndarray], values: dict[str, np.ndarray]) -> np.ndarray:
    """(lines, states)"""
    return sum(model[k][:, values[k]].T for k in SIZES)


def transfer(model: dict[str, np.ndarray], e: np.ndarray, first: bool) -> np.ndarray:
    """Best scores from each state before a block (any, if it is the first) to each at its end."""
    m = np.tile(model["start"] + e[0], (STATES, 1)) if first else model["step"] + e[0]
    for row in e[1:]:
        m = (m[:, :, None] + model["step"][None]).max(axis=1) + row
    return m


def viterbi(model: dict[str, np.ndarray], e: np.ndarray, before: int | None = None, last: int | None = None) -> np.ndarray:
    """The most likely states of a run of lines, after a line of state `before` and with the last one's given."""
    score = e[0] + (model["start"] if before is None else model["step"][before])
    back = np.zeros((len(e), STATES), np.int8)
    for t in range(1, len(e)):
        options = score[:, None] + model["step"]
        back[t] = options.argmax(axis=0)
        score = options.max(axis=0) + e[t]
    out = np.zeros(len(e), np.int64)
    out[-1] = int(score.argmax()) if last is None else last
    for t in range(len(e) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def many_viterbi(model: dict[str, np.ndarray], e: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """viterbi() of many runs without fixed ends, a step of all runs of one length at a time."""
    out = np.zeros(len(e), np.int64)
    sizes = np.diff(bounds)
    for n in np.unique(sizes):
        at = bounds[:-1][sizes == n][:, None] + np.arange(n)
        em = e[at]
        score, back = em[:, 0] + model["start"], np.zeros((len(at), n, STATES), np.int8)
        for t in range(1, n):
            options = score[:, :, None] + model["step"]
            back[:, t] = options.argmax(axis=1)
            score = options.max(axis=1) + em[:, t]
        now = score.argmax(axis=1)
        for t in range(n - 1, -1, -1):
            out[at[:, t]] = now
            now = back[np.arange(len(at)), t, now]
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Whole blocks of rows that are sorted by (key, block): a block that goes on in the next batch waits for it."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        df = batch.to_pandas()
        df = df if rest is None else pd.concat([rest, df], ignore_index=True)
        if not len(df):
            continue
        bounds = runs(_block_ids(df))
        rest = df.iloc[bounds[-2] :]
        if bounds[-2]:
            yield df.iloc[: bounds[-2]].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def _block_ids(df: pd.DataFrame) -> np.ndarray:
    """A number that changes where the block does."""
    new = (df["key"] != df["key"].shift()) | (df["block"] != df["block"].shift())
    return new.cumsum().to_numpy()


def _product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The max-plus product of the matrices of a group, in their order."""
    out = None
    for m in pdf.sort_values("block")["matrix"]:
        m = np.array(m).reshape(STATES, STATES)
        out = m if out is None else (out[:, :, None] + m[None]).max(axis=1)
    return pd.DataFrame({"key": [key[0]], "block": [key[1]], "matrix": [out.ravel()]})


def _borders(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states before and at the end of each part of a group, from the one before the group (-1: none) and at its end (-1: any)."""
    pdf = pdf.sort_values("block")
    before, last = int(pdf["before"].iloc[0]), int(pdf["last"].iloc[0])
    matrices = [np.array(m).reshape(STATES, STATES) for m in pdf["matrix"]]
    score, back = matrices[0][max(before, 0)], []
    for m in matrices[1:]:
        options = score[:, None] + m
        back.append(options.argmax(axis=0))
        score = options.max(axis=0)
    ends = [int(score.argmax()) if last < 0 else last]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "before": [before, *ends[:-1]], "last": ends})


def fixed_borders(spark: SparkSession, matrices: DataFrame) -> DataFrame:
    """(key, block, before, last) from (key, block, matrix) of all blocks of the conversations, counted from 0."""
    levels = [written(spark, matrices, "matrices")]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) >= FAN:
        groups = levels[-1].groupBy("key", F.floor(F.col("block") / FAN).alias("part"))
        levels.append(written(spark, groups.applyInPandas(_product, "key string, block long, matrix array<double>"), "matrices"))
    fixed = levels[-1].select("key", F.lit(0).cast("long").alias("part"), F.lit(-1).alias("before"), F.lit(-1).alias("last")).distinct()
    for level in reversed(levels):
        parts = level.withColumn("part", F.floor(F.col("block") / FAN)).join(fixed, ["key", "part"])
        fixed = written(spark, parts.groupBy("key", "part").applyInPandas(_borders, "key string, block long, before int, last int"), "borders")
        fixed = fixed.withColumnRenamed("block", "part")
    return fixed.withColumnRenamed("part", "block")


def parsed(spark: SparkSession, lines: DataFrame, model: dict[str, np.ndarray], order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """(conv_id, order, role, opens, rendered) of lines (conv_id, order, text).

    `rendered`, put together in order, is the conversation: a turn opens with `<|role|>` on a line of its own, lines of
    one turn are joined by line breaks, speaker markers are dropped.
    """
    kind = dict(lines.dtypes)["conv_id"]
    rows = numbered(lines, order).withColumn("block", F.floor(F.col("rank") / BLOCK))
    rows = written(spark, rows.select("key", "block", "rank", *order, "text", *[v.alias(k) for k, v in symbols(F.col("text")).items()]), "symbols")
    shared = spark.sparkContext.broadcast(model)

    long = written(spark, rows.where(F.col("block") > 0).select("key").distinct(), "long-conversations")

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for df in _blocks(batches):
            bounds = runs(_block_ids(df))
            e = emissions(shared.value, {k: df[k].to_numpy() for k in SIZES})
            out = [(df["key"][a], df["block"][a], transfer(shared.value, e[a:b], df["block"][a] == 0).ravel()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"key": pa.array([o[0] for o in out], pa.string()), "block": pa.array([o[1] for o in out], pa.int64()), "matrix": pa.array([o[2] for o in out], pa.list_(pa.float64()))})

    numbers = rows.select("key", "block", "rank", *SIZES).join(long, "key")
    summaries = numbers.repartition("key", "block").sortWithinPartitions("key", "block", "rank").mapInArrow(transfers, "key string, block long, matrix array<double>")
    fixed = fixed_borders(spark, summaries)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(marker_pattern(r)) for r in ROLES]
        m = shared.value
        for df in _blocks(batches):
            bounds = runs(_block_ids(df))
            e = emissions(m, {k: df[k].to_numpy() for k in SIZES})
            state = many_viterbi(m, e, bounds)
            before = np.full(len(df), -1)
            before[1:] = state[:-1]
            first, last = df["before"].to_numpy(), df["last"].to_numpy()
            before[bounds[:-1]] = -1
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if not np.isnan(last[a]):
                    state[a:b] = viterbi(m, e[a:b], None if first[a] < 0 else int(first[a]), int(last[a]))
                    before[a:b] = [first[a], *state[a : b - 1]]
            role, before = state // 2, np.where(before < 0, -1, before // 2)
            opens = role != before
            bare = [patterns[k - 1].sub("", t, count=1) if k else t for t, k in zip(df["text"], df["marker"], strict=True)]
            rendered = [(f"{chr(10) if p >= 0 else ''}<|{ROLES[r]}|>\n" if o else "\n") + t for t, r, o, p in zip(bare, role, opens, before, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(df["key"], pa.string()), *[pa.array(df[c], pa.int64(), from_pandas=True) for c in order], pa.array([ROLES[r] for r in role], pa.string()), pa.array(opens, pa.bool_()), pa.array(rendered, pa.string())],
                ["key", *order, "role", "opens", "rendered"],
            )

    joined = rows.join(fixed, ["key", "block"], "left").repartition("key", "block").sortWithinPartitions("key", "block", "rank")
    numbers = ", ".join(f"{c} long" for c in order)
    decoded = joined.select("key", "block", *order, "text", *SIZES, "before", "last").mapInArrow(decode, f"key string, {numbers}, role string, opens boolean, rendered string")
    return decoded.select(F.when(F.col("key") != "\0null", F.col("key")).cast(kind).alias("conv_id"), *order, "role", "opens", "rendered")
