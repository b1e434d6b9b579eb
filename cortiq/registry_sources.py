"""Queries over datasets, files and preparation, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import prep, render, spaces, stats
from .registry import _RUNS, _runs, query, six
from .sources import arrays, catalog, datasets, records, volumes
from .sources.scratch import shared_path
from .tables import read

#: (dataset, task, run, between subject and suffix in arrays, and in confounds)
_NAMES = (
    ("bellaria", "rs1", 1, "_task-rs1", "_task-rs1"),
    ("spacetop", "alignvideo", 1, "_ses-01_task-alignvideo_acq-mb8_run-01", "_ses-01_task-alignvideo_acq-mb8_run-01"),
    ("spacetop", "alignvideo", 7, "_ses-02_task-alignvideo_acq-mb8_run-03", "_ses-02_task-alignvideo_acq-mb8_run-03"),
    ("spacetop", "alignvideo", 11, "_ses-03_task-alignvideo_acq-mb8_run-03", "_ses-03_task-alignvideo_acq-mb8_run-03"),
    ("spacetop", "alignvideo", 13, "_ses-04_task-alignvideo_acq-mb8_run-02", "_ses-04_task-alignvideo_acq-mb8_run-02"),
    ("raiders", "raiders", 3, "_ses-raiders_task-movie_run-03", "_ses-raiders_task-movie_run-3"),
    ("raiders", "actions", 2, "_ses-actions1_task-actions_run-02", "_ses-actions1_task-actions_run-2"),
    ("raiders", "actions", 8, "_ses-actions2_task-actions_run-04", "_ses-actions2_task-actions_run-4"),
    ("hca", "restap", 2, "_ses-V1_task-restap_run-02", "_ses-V1_task-restap_run-02"),
    ("monkey-action", "actions", 4, "_ses-actions_task-actions_run-04", "_ses-actions_task-actions_run-04"),
    ("whiplash-c1", "whiplash", 1, "_ses-3_task-movie_run-02", "_ses-3_task-movie_run-2"),
    ("whiplash-c2", "whiplash", 2, "_ses-3_task-movie_run-02", "_ses-3_task-movie_run-02"),
    ("whiplash-c3", "whiplash", 1, "_task-video_run-01", "_task-video_run-01"),
    ("whiplash-c3", "localizer", 1, "_task-localizer_run-01", "_task-localizer_run-01"),
    ("hybr", "bang", 12, "_task-bang_run-12", "_task-bang_run-12"),
    ("forrest", "forrest", 8, "_task-forrest_run-08", "_task-forrest_run-8"),
    ("praiders", "raiders", 10, "_task-raiders_run-10", "_task-raiders_run-10"),
)
_VALUES = ", ".join(f"({i}, '{d}', '{t}', {r}, '{a}', '{b}')" for i, (d, t, r, a, b) in enumerate(_NAMES))


@query(
    f"""SELECT 'sub-' || c_custkey || a || '.npy' AS array_name, 'sub-' || c_custkey || b || '_desc-confounds_timeseries.tsv' AS confounds_name
FROM customer JOIN (VALUES {_VALUES}) n(i, dataset, task, run, a, b) ON c_custkey % {len(_NAMES)} = i"""
)
def dataset_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a run of each customer, who take part in the datasets with names of their own in turn."""
    runs = spark.createDataFrame([(i, *n[:3]) for i, n in enumerate(_NAMES)], "i int, dataset string, task string, run int")
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("subject"), (F.col("c_custkey") % len(_NAMES)).cast("int").alias("i"))
    rows = people.join(F.broadcast(runs), "i").drop("i")
    arrays_named = datasets.file_names(rows).withColumnRenamed("name", "array_name")
    return datasets.file_names(arrays_named, datasets.CONFOUNDS[1]).select("array_name", F.col("name").alias("confounds_name"))


@query(
    """SELECT d.*, count(c_custkey) AS runs FROM (VALUES ('bologna', '20.2.7', 1, 69, 0, 0), ('bellaria', '20.2.7', 4, 1, 0, 0), ('forrest', '20.2.7', 7, 15, 0, 0), ('dalmatians', '20.2.7', 2, 50, 0, 0),
('spacetop', '23.2.0', 2, -1, 0, 49), ('camcan', '20.2.7', 3, -1, 0, 0), ('id1000', '20.2.7', 1, -1, 0, 0), ('raiders', '23.2.0', 2, 23, 0, 4), ('praiders', '20.2.7', 1, -1, 0, 0),
('budapest', '23.2.0', 3, 21, 0, 0), ('hca', 'HCA2.0', 5, -1, 0, 0), ('monkeykingdom', '20.2.7', 4, 24, 0, 1), ('monkey-kingdom-eng', '24.1.0', 2, 10, 0, 1), ('monkey-action', '24.1.0', 1, 19, 0, 0),
('life', '20.2.7', 3, 19, 29, 4), ('hbn-ssi', '23.2.0', 4, 13, 0, 0), ('whiplash-c1', '20.2.7', 1, -1, 0, 0), ('whiplash-c2', '23.2.0', 1, -1, 0, 0), ('whiplash-c3', '23.2.0', 2, -1, 0, 0),
('ibc', '23.2.0', 2, -1, 0, 0), ('goodbadugly', '20.2.7', 1, -1, 0, 0), ('hybr', '24.1.0', 15, 4, 0, 0)) d(name, version, tasks, subjects, conditions, spans)
LEFT JOIN customer ON c_custkey % 22 = list_position(['bellaria', 'bologna', 'budapest', 'camcan', 'dalmatians', 'forrest', 'goodbadugly', 'hbn-ssi', 'hca', 'hybr', 'ibc', 'id1000', 'life', 'monkey-action', 'monkey-kingdom-eng', 'monkeykingdom', 'praiders', 'raiders', 'spacetop', 'whiplash-c1', 'whiplash-c2', 'whiplash-c3'], name) - 1 GROUP BY ALL"""
)
def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The described datasets, with the customers who are dealt to them as runs."""
    spans = datasets.intervals(spark).groupBy(F.col("dataset").alias("name")).agg(F.count(F.lit(1)).cast("int").alias("spans"))
    names = sorted(r["name"] for r in datasets.datasets(spark).select("name").collect())  # the described datasets
    runs = read(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % len(names)).alias("i")).agg(F.count(F.lit(1)).alias("runs"))
    dealt = spark.createDataFrame(list(enumerate(names)), "i long, name string").join(runs, "i", "left").select("name", F.coalesce("runs", F.lit(0)).alias("runs"))
    found = datasets.datasets(spark).join(spans, "name", "left").join(dealt, "name")
    return found.select("name", "version", F.size("tasks").alias("tasks"), F.coalesce("subjects", F.lit(-1)).alias("subjects"), F.size("conditions").alias("conditions"), F.coalesce("spans", F.lit(0)).alias("spans"), "runs")


# Six hours a time point, users by remainder as runs and vertices; runs of each subject end at another time.
_LAID = """cells AS (SELECT event_type AS subject, 1 + (user_id % 2)::INT AS run, (date_diff('second', TIMESTAMP '2024-01-01', ts::TIMESTAMP) // 21600)::INT AS t, (user_id % 5)::INT AS v, sum(value) AS x FROM events GROUP BY ALL),
n AS (SELECT DISTINCT subject, run, (80 + 9 * run + 2 * length(subject))::INT AS n FROM cells),
laid AS (SELECT n.subject, n.run, t.t, v.v, n.n, coalesce(c.x, 0.0) AS x, (1 + t.t % 7)::DOUBLE AS c FROM n CROSS JOIN (SELECT unnest(range(0, 200)) AS t) t CROSS JOIN (SELECT unnest(range(0, 5)) AS v) v
  LEFT JOIN cells c ON c.subject = n.subject AND c.run = n.run AND c.t = t.t AND c.v = v.v WHERE t.t < n.n)"""


def _laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    cells = events.groupBy(F.col("event_type").alias("subject"), (1 + F.col("user_id") % 2).cast("int").alias("run"), F.floor(seconds / 21600).cast("int").alias("t"), (F.col("user_id") % 5).cast("int").alias("v")).agg(F.sum("value").alias("x"))
    grid = cells.select("subject", "run").distinct().withColumn("n", 80 + 9 * F.col("run") + 2 * F.length("subject"))
    grid = grid.withColumn("t", F.explode(F.expr("sequence(0, n - 1)"))).withColumn("v", F.explode(F.array(*map(F.lit, range(5)))))
    return grid.drop("n").join(cells, ["subject", "run", "t", "v"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))


_CUT = f"""{_LAID}, cut AS (SELECT subject, run, t - CASE WHEN run = 1 THEN 0 ELSE 10 END AS t, v, x, c, n - CASE WHEN run = 1 THEN 10 ELSE 20 END AS m FROM laid WHERE t >= CASE WHEN run = 1 THEN 0 ELSE 10 END AND t < n - 10)"""


def _raiders(spark: SparkSession, sf_dir: str) -> catalog.Dataset:
    """The cells as two runs of a film that is cut at both ends, with a confound and a mask, in tables of their own."""
    c = catalog.Catalog(spark, shared_path(spark, "catalog"))
    run = {"dataset": "raiders", "version": "23.2.0", "task": "raiders"}
    laid = _laid(spark, sf_dir)
    with_tokens = lambda df, tokens: df.withColumns({k: F.lit(v) for k, v in tokens.items()})
    c.write(with_tokens(laid, run | {"space": "onavg-ico32", "resample": "1step_pial_overlap", "hemi": "l"}), "signal", [*run, "space", "resample", "hemi", "subject", "run"])
    points = laid.select("subject", "run", "t").distinct().withColumn("c", F.array((1 + F.col("t") % 7).cast("double")))
    c.write(with_tokens(points, run), "confounds", [*run, "subject", "run"])
    mask = {"space": "onavg-ico32", "which": "aparc.a2009s", "hemi": "l", "group": "on1031_trimmed", "resample": "overlap-8div"}
    c.write(with_tokens(spark.range(5).select(F.col("id").cast("int").alias("v"), (F.col("id") != 3).alias("keep")), mask), "masks", list(mask))
    return c.dataset("raiders")


@query(
    f"""WITH {_CUT}, b AS (SELECT subject, run, v, sum(c * x) / sum(c * c) AS b FROM cut GROUP BY ALL), e AS (SELECT subject, run, t, v, x - b * c AS x FROM cut JOIN b USING (subject, run, v)),
first AS (SELECT DISTINCT subject, m FROM cut WHERE run = 1)
SELECT subject, (t + CASE WHEN run = 1 THEN 0 ELSE first.m END)::BIGINT AS t, v::BIGINT AS v,
round(coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0.0), 6) + 0.0 AS x FROM e JOIN first USING (subject) WHERE v <> 3 WINDOW w AS (PARTITION BY subject, run, v)"""
)
def dataset_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of unequal length: scanned, masked, cut with their confounds, regressed, standardised and put one after the other."""
    found = _raiders(spark, sf_dir).data("raiders", "l")
    return found.select("subject", F.col("t").cast("long").alias("t"), F.col("v").cast("long").alias("v"), six("x"))


@query(f"WITH {_CUT} SELECT subject, run::BIGINT AS run, max(t)::BIGINT + 1 AS n, round(sum(x * (t + 1)), 4) + 0.0 AS moment, round(sum(c * (t + 1)), 4) + 0.0 AS confound FROM cut WHERE v = 0 GROUP BY ALL")
def dataset_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal and its confound after the same cut."""
    d = _raiders(spark, sf_dir)
    raw = d.signal("raiders", "l")
    both = d.kept(raw, "raiders").where("v = 0").join(d.kept(d.confounds("raiders")[0], "raiders", raw), ["subject", "run", "t"])
    at = F.col("t") + 1
    return both.groupBy("subject", F.col("run").cast("long").alias("run")).agg((F.max("t") + 1).cast("long").alias("n"), F.sum(F.col("x") * at).alias("moment"), F.sum(F.col("c")[0] * at).alias("confound")).select("subject", "run", "n", six("moment", 4), six("confound", 4))


@query(
    f"""WITH {_RUNS}, g AS (SELECT subject, run, t, avg(x) AS c FROM runs GROUP BY ALL), d AS (SELECT * FROM runs JOIN g USING (subject, run, t)),
b AS (SELECT subject, run, v, sum(c * x) / sum(c * c) AS b FROM d GROUP BY ALL)
SELECT subject, run, t, v, round(x - b * c, 6) + 0.0 AS x FROM d JOIN b USING (subject, run, v)"""
)
def global_signal_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over vertices as the one regressor."""
    signal = _runs(spark, sf_dir)
    none = signal.select("subject", "run", "t").distinct().withColumn("c", F.array().cast("array<double>"))
    return prep.get_prep("default-gsr", z=False)(signal, none).select("subject", "run", "t", "v", six("x"))


@query(f"WITH {_RUNS}, k AS (SELECT *, dense_rank() OVER (PARTITION BY subject, run ORDER BY t) - 1 AS n FROM runs WHERE t % 4 <> 2) SELECT subject, run, n::BIGINT AS t, v, round(x, 6) + 0.0 AS x FROM k")
def renumbered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.renumbered(_runs(spark, sf_dir).where("t % 4 <> 2")).select("subject", "run", "t", "v", six("x"))


@query(f"WITH {_RUNS} SELECT subject, run, t - 2 AS t, v, round(x, 6) + 0.0 AS x FROM (SELECT *, max(t) OVER (PARTITION BY subject, run) AS top FROM runs) WHERE t >= 2 AND t <= top - 3")
def trimmed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.trimmed(_runs(spark, sf_dir), 2, 3).select("subject", "run", "t", "v", six("x"))


# Files, types and colors


@query(
    """WITH f AS (SELECT p_name || (['.nii.gz', '.gii', '.npy', '.npz', '.tsv', '.mgh', '.dat', '.json'])[1 + p_partkey % 8] AS path, p_partkey % 3 = 0 AS odd FROM part)
SELECT path, CASE WHEN path LIKE '%.nii.gz' OR path LIKE '%.mgh' THEN 'volume' WHEN path LIKE '%.gii' THEN 'surface' WHEN path LIKE '%.npy' THEN 'npy' WHEN path LIKE '%.npz' THEN 'npz'
WHEN path LIKE '%.tsv' OR path LIKE '%.json' THEN 'text' WHEN odd THEN 'binary' ELSE 'text' END AS kind FROM f"""
)
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by suffix, and by the first bytes where a suffix says nothing."""
    endings = F.array(*map(F.lit, (".nii.gz", ".gii", ".npy", ".npz", ".tsv", ".mgh", ".dat", ".json")))
    head = F.when(F.col("p_partkey") % 3 == 0, F.unhex(F.lit("FF00FE"))).otherwise(F.encode(F.lit("text"), "UTF-8")).cast("string")
    path = F.concat("p_name", F.element_at(endings, (1 + F.col("p_partkey") % 8).cast("int")))
    return read(spark, sf_dir, "part").select(path.alias("path"), arrays.kind_of(path, head).alias("kind"))


@query(
    """WITH m AS (SELECT n_regionkey AS r, min(c_acctbal)::BIGINT AS low, max(c_acctbal * pow(10, n_regionkey))::BIGINT AS high, n_regionkey <> 3 AS whole FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey)
SELECT r, CASE WHEN NOT whole THEN 'double' WHEN low >= -128 AND high < 128 THEN 'tinyint' WHEN low >= -32768 AND high < 32768 THEN 'smallint' WHEN low >= -2147483648 AND high < 2147483648 THEN 'int' ELSE 'bigint' END AS kind FROM m"""
)
def narrowest_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = both.groupBy(F.col("n_regionkey").alias("r")).agg(F.round(F.min("c_acctbal")).cast("long").alias("low"), F.round(F.max(F.col("c_acctbal") * F.pow(F.lit(10.0), F.col("n_regionkey")))).cast("long").alias("high"))
    return m.select("r", C.narrowest_type(F.col("low"), F.col("high"), F.col("r") != 3).alias("kind"))


@query("SELECT n_nationkey AS n, n_nationkey::BIGINT AS side FROM nation")
def triangle_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), C.triangle_side((n * (n + 1) / 2).cast("long")).alias("side"))


# Spaces


@query(
    """WITH w AS (SELECT c_nationkey AS src, c_custkey % 50 AS dst, 1.0 / (1 + c_custkey % 3) AS w FROM customer), x AS (SELECT s_nationkey AS v, avg(s_acctbal) AS x FROM supplier GROUP BY ALL)
SELECT dst::BIGINT AS v, count(*) AS n, round(coalesce(CASE WHEN bool_or(src % 4 = 1 OR x IS NULL) THEN -1.0 ELSE sum(x * w) END, -1.0), 4) + 0.0 AS x FROM w LEFT JOIN x ON w.src = x.v GROUP BY dst"""
)
def upsampled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' balances by nation, masked, put in place and carried over to a finer space; what has a missing source is missing (-1)."""
    w = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 50).alias("dst"), (1.0 / (1 + F.col("c_custkey") % 3)).alias("w"))
    mask = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("v"), (F.col("n_nationkey") % 4 != 1).alias("keep"))
    values = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("v")).agg(F.avg("s_acctbal").alias("x"))
    kept = spaces.reindexed(mask).join(values, "v").select("vm", "x")
    n = w.groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return spaces.upsampled(kept, w, mask).join(n, "v").select("v", "n", F.nanvl("x", F.lit(-1.0)).alias("x")).select("v", "n", six("x", 4))


@query(
    """WITH p AS (SELECT o_custkey % 6 AS label, o_orderkey % 40 AS src, avg(o_totalprice) AS p FROM orders GROUP BY ALL), w AS (SELECT c_custkey % 40 AS src, c_nationkey AS dst, count(*)::DOUBLE AS w FROM customer GROUP BY ALL),
r AS (SELECT label, dst, sum(p * w) AS x FROM p JOIN w USING (src) GROUP BY ALL)
SELECT dst AS v, CASE WHEN label = 0 THEN -1 ELSE label END::BIGINT AS label FROM r QUALIFY row_number() OVER (PARTITION BY dst ORDER BY x DESC, label) = 1"""
)
def parcel_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest label of each target; background is -1."""
    p = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 6).alias("label"), (F.col("o_orderkey") % 40).alias("v")).agg(F.avg("o_totalprice").alias("p"))
    w = read(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 40).alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return spaces.parcellation(p, w).select("v", F.col("label").cast("long").alias("label"))


@query(
    """SELECT l_returnflag AS name, count(*)::BIGINT AS n, count(DISTINCT l_quantity)::BIGINT AS n_distinct, round(quantile_cont(l_quantity, 0.4), 4) + 0.0 AS p40, round(max(l_quantity), 4) + 0.0 AS p100, NULL::VARCHAR AS listed FROM lineitem GROUP BY ALL
UNION ALL SELECT 'all', count(*), count(DISTINCT l_linenumber), NULL, NULL, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) FROM lineitem"""
)
def array_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing shows: percentiles of many values, by group; all of few values."""
    lines = read(spark, sf_dir, "lineitem")
    many = stats.summary(lines, "l_quantity", ["l_returnflag"]).select(F.col("l_returnflag").alias("name"), "n", "n_distinct", F.col("percentiles")[2].alias("p40"), F.col("percentiles")[5].alias("p100"), F.array_join(F.col("values").cast("array<string>"), ",").alias("listed"))
    few = stats.summary(lines.withColumn("l_linenumber", F.col("l_linenumber").cast("double")), "l_linenumber").select(F.lit("all").alias("name"), "n", "n_distinct", F.col("percentiles")[2].alias("p40"), F.col("percentiles")[5].alias("p100"), F.array_join(F.col("values").cast("array<int>").cast("array<string>"), ",").alias("listed"))
    return many.unionByName(few).select("name", "n", "n_distinct", six("p40", 4), six("p100", 4), "listed")


@query(
    """WITH r AS (SELECT quantile_cont(c_acctbal, 0.01) AS low, quantile_cont(c_acctbal, 0.99) AS high FROM customer),
k AS (SELECT c_custkey AS v, least(floor(greatest(0.0, least(1.0, (c_acctbal - low) / (high - low))) * 256), 255) AS k, c_custkey % 7 = 0 AS missing, c_custkey % 2 = 0 AS gyrus FROM customer, r)
SELECT v, round(CASE WHEN missing THEN CASE WHEN gyrus THEN 0.8 ELSE 0.6 END ELSE k / 255 END, 6) + 0.0 AS r, round(CASE WHEN missing THEN CASE WHEN gyrus THEN 0.8 ELSE 0.6 END ELSE 1 - k / 255 END, 6) + 0.0 AS g FROM k"""
)
def surface_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances between their 1st and 99th percentile by a color map; what is missing shows the surface."""
    people = read(spark, sf_dir, "customer")
    low, high = render.value_range(people, "c_acctbal")
    values = people.select(F.col("c_custkey").alias("v"), F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("x"))
    colormap = spark.range(256).select(F.col("id").cast("int").alias("k"), (F.col("id") / 255).alias("r"), (1 - F.col("id") / 255).alias("g"), F.lit(0.5).alias("b"), F.lit(1.0).alias("a"))
    gyri = people.select(F.col("c_custkey").alias("v"), (F.col("c_custkey") % 2 == 0).alias("gyrus"))
    return render.colored(values, colormap, gyri, high, low).select("v", six("r"), six("g"))


_VOXELS = """voxels AS (SELECT c_mktsegment AS name, (c_custkey % 6)::INT AS i, (c_nationkey % 5)::INT AS j, (c_custkey % 4)::INT AS k, (c_nationkey % 3)::INT AS t, round(sum(c_acctbal), 2) AS x FROM customer GROUP BY ALL)"""


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of customers' balances as volumes, one for each segment."""
    c = read(spark, sf_dir, "customer")
    at = [(F.col("c_custkey") % 6).cast("int").alias("i"), (F.col("c_nationkey") % 5).cast("int").alias("j"), (F.col("c_custkey") % 4).cast("int").alias("k"), (F.col("c_nationkey") % 3).cast("int").alias("t")]
    return c.groupBy(F.col("c_mktsegment").alias("name"), *at).agg(F.round(F.sum("c_acctbal"), 2).alias("x"))


@query(f"WITH {_VOXELS} SELECT name, i, j, k, t, round(x, 4) + 0.0 AS x FROM voxels WHERE x <> 0")
def volumes_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes written as gz files, and read by the data source."""
    folder = shared_path(spark, "volumes")
    volumes.write_volumes(_voxels(spark, sf_dir), folder, (6, 5, 4, 3)).count()
    found = volumes.cells(volumes.read_volumes(spark, folder)).where("x <> 0")
    name = F.regexp_extract("path", r"([^/]*)\.nii\.gz$", 1)
    return found.select(name.alias("name"), "i", "j", "k", "t", six("x", 4))


@query(f"WITH {_VOXELS} SELECT name || '.nii.gz' AS path, CASE WHEN max(CASE WHEN k = 0 THEN abs(x) END) > 0 THEN 'values differ' ELSE 'same' END AS status, round(max(CASE WHEN k = 0 THEN abs(x) ELSE 0 END), 4) + 0.0 AS most FROM voxels GROUP BY name")
def volumes_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes against those without their first slices."""
    one, two = shared_path(spark, "volumes"), shared_path(spark, "volumes")
    voxels = _voxels(spark, sf_dir)
    volumes.write_volumes(voxels, one, (6, 5, 4, 3)).count()
    volumes.write_volumes(voxels.where("k > 0"), two, (6, 5, 4, 3)).count()
    return volumes.compared_volumes(spark, one, two).select("path", "status", six("most", 4))


@query(
    """SELECT o_orderstatus, n, round(total, 2) + 0.0 AS total, records, recorded_rows, round(recorded_total, 2) + 0.0 AS recorded_total FROM (SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_orderstatus),
(SELECT 1::BIGINT AS records, count(DISTINCT o_orderstatus) AS recorded_rows, sum(o_totalprice) AS recorded_total FROM orders)"""
)
def recorded_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that two calls ask for is computed once; its record, with an observed sum, stands beside it."""

    def totals() -> DataFrame:
        return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))

    folder = shared_path(spark, "recorded")
    for _ in range(2):
        found = records.save_results(spark, f"{folder}/totals", totals, metrics={"total": F.sum("total")})
    seen = records.records(spark, folder).agg(F.count(F.lit(1)).alias("records"), F.max("rows").alias("recorded_rows"), F.max(F.col("metrics")["total"]).alias("recorded_total"))
    return found.crossJoin(F.broadcast(seen)).select("o_orderstatus", "n", six("total", 2), "records", "recorded_rows", six("recorded_total", 2))  # one row beside
