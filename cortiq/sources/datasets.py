"""What datasets exist: spaces, versions, tasks, subjects, conditions, names of files and the time points that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BOTH = ("1step_pial_overlap", "1step_linear_overlap")

#: Key, stored name, surface space, volume space, surface and volume resampling, preprocessing version, repetition
#: time in s, tasks.
DATASETS = (
    ("bologna", "bologna", "onavg-ico32", "mni-4mm", *_BOTH, "20.2.7", None, "rest"),
    ("bellaria", "bellaria", "onavg-ico32", "mni-4mm", *_BOTH, "20.2.7", None, "rs1 rsmirror selfknown landscapeunknown"),
    ("forrest", "forrest", "onavg-ico32", "mni-4mm", *_BOTH, "20.2.7", 2.0, "forrest movielocalizer objectcategories retmapccw retmapclw retmapcon retmapexp"),
    ("dalmatians", "dalmatians", "onavg-ico32", "mni-4mm", *_BOTH, "20.2.7", None, "dalmatians scrambled"),
    ("spacetop", "spacetop", "onavg-ico32", "mni-2mm", *_BOTH, "23.2.0", None, "alignvideo faces"),
    ("camcan", "camcan", "onavg-ico32", "mni-4mm", *_BOTH, "20.2.7", None, "bang rest smt"),
    ("id1000", "id1000", "onavg-ico32", "mni-4mm", *_BOTH, "20.2.7", None, "moviewatching"),
    ("raiders", "raiders", "onavg-ico32", "mni-4mm", *_BOTH, "23.2.0", 1.0, "raiders actions"),
    ("praiders", "raiders", "onavg-ico32", "mni-4mm", *_BOTH, "20.2.7", None, "raiders"),
    ("budapest", "budapest", "onavg-ico32", "mni-4mm", *_BOTH, "23.2.0", 1.0, "budapest hyperface localizer"),
    ("hca", "HCA", "onavg-ico32", None, "msmsulc_uncleaned", None, "HCA2.0", None, "restap restpa caritpa facenamepa vismotorpa"),
    ("monkeykingdom", "monkey-kingdom", "onavg-ico32", "mni-4mm", *_BOTH, "20.2.7", None, "monkey rest localizer language"),
    ("monkey-kingdom-eng", "monkey-kingdom-eng", "onavg-ico32", None, "1step_pial_overlap", None, "24.1.0", None, "monkey rest"),
    ("monkey-action", "monkey-action", "onavg-ico32", None, "1step_pial_overlap", None, "24.1.0", None, "actions"),
    ("life", "life", "onavg-ico32", "mni-4mm", *_BOTH, "20.2.7", None, "life tax beh"),
    ("hbn-ssi", "hbn-ssi", "onavg-ico32", "mni-4mm", *_BOTH, "23.2.0", None, "raiders matrix walle afewgoodmen"),
    ("whiplash-c1", "whiplash-c1", "onavg-ico32", "mni-4mm", *_BOTH, "20.2.7", None, "whiplash"),
    ("whiplash-c2", "whiplash-c2", "onavg-ico32", "mni-4mm", *_BOTH, "23.2.0", None, "whiplash"),
    ("whiplash-c3", "whiplash-c3", "onavg-ico32", "mni-4mm", *_BOTH, "23.2.0", None, "whiplash localizer"),
    ("ibc", "IBC", "onavg-ico32", "mni-4mm", *_BOTH, "23.2.0", None, "raiders tgbu"),
    ("goodbadugly", "GoodBadUgly", "onavg-ico32", "mni-4mm", *_BOTH, "20.2.7", None, "goodbadugly"),
    ("hybr", "hybr", "onavg-ico32", None, *_BOTH, "24.1.0", None, "alanguage bang budapest calculation falseXbelief frithXhappe motion objectXcategory rest retinotopy sherlock vlanguage voice vwfa workingXmemory"),
)
COLUMNS = "name string, stored string, surface_space string, volume_space string, surface_resample string, volume_resample string, version string, tr double, tasks string"
#: Other names that a dataset is known by.
ALIASES = {"monkey-kingdom": "monkeykingdom"}

#: Subjects by dataset; numbers after a common beginning. camcan, id1000 and others have lists of their own (subject_sets).
SUBJECTS = {
    "bologna": ("", " ".join(f"{i:02d}" for i in range(1, 70))),
    "bellaria": ("", "100"),
    "forrest": ("", "01 02 03 04 05 06 09 10 14 15 16 17 18 19 20"),
    "dalmatians": (
        "",
        "AB033 AB034 AB035 AB036 AB037 AB038 AB039 AB041 AB042 AB043 AB053 AO003 AO004 AO005 AO006 AO007 AO008 AO009 AO010 AO011 AO027 "
        "AV012 AV013 AV014 AV015 AV016 AV017 AV018 AV019 AV022 AV032 VD044 VD045 VD046 VD047 VD048 VD049 VD050 VD051 VD052 "
        "VO020 VO021 VO023 VO024 VO025 VO026 VO028 VO029 VO030 VO031",
    ),
    "raiders": ("sid000", "005 007 009 010 012 013 020 021 024 029 034 052 102 114 120 134 142 278 416 433 499 522 535"),
    "budapest": ("sid000", "005 007 009 010 013 020 021 024 029 034 052 114 120 134 142 278 416 499 522 535 560"),
    "monkeykingdom": ("sid00", "1123 1293 1294 1678 1784 1830 1835 1986 2015 2161 2180 2317 2325 2406 2414 2435 2446 2449 2454 2471 2499 2509 2519 2570"),
    "monkey-kingdom-eng": ("sid00", "2042 2409 2470 2478 2596 2918 3221 3222 3223 3224"),
    "monkey-action": ("sid00", "1784 1826 2317 2742 2843 2951 2972 3017 3146 3163 3191 3195 3210 3227 3250 3256 3258 3268 3274"),
    "life": ("rid0000", "01 05 06 09 12 14 17 19 20 24 27 31 32 33 34 36 37 38 41"),
    "hbn-ssi": ("00311", "21 22 23 26 27 30 31 32 33 24 25 28 29"),
    "hybr": ("sid00", "0004 2046 2317 2742"),
}
#: Named sets of a dataset's subjects.
SUBJECT_SETS = {("life", "attention"): ("rid0000", "01 12 17 24 27 31 32 33 34 36 37 41")}
#: What the animals of life's videos are, and what they do; conditions are the pairs, then each alone.
TAXA, BEHAVIORS = ("primate", "ungulate", "bird", "reptile", "insect"), ("eating", "fighting", "running", "swimming")
CONDITIONS = {"life": (*(f"{t}_{b}" for t in TAXA for b in BEHAVIORS), *TAXA, *BEHAVIORS)}

#: Fixed values: (dataset, task, run, start, end) of the time points kept; a negative end counts from the last.
INTERVALS = (
    *(
        ("spacetop", "alignvideo", run, start, end)
        for run, spans in enumerate(
            (
                ((17, 130), (207, 638), (714, 847), (923, 1007)),
                ((17, 354), (431, 555), (632, 1162), (1238, 1304)),
                ((17, 248), (325, 453), (530, 575), (652, 949)),
                ((17, 326), (403, 1140)),
                ((17, 75), (152, 307), (384, 626), (702, 769)),
                ((17, 276), (352, 805), (881, 1324), (1401, 1787)),
                ((17, 270), (346, 736), (813, 871), (948, 1085)),
                ((17, 120), (196, 300), (377, 695), (771, 843)),
                ((17, 476), (553, 599), (675, 741), (817, 1086)),
                ((17, 339), (415, 604), (680, 1108), (1184, 1261)),
                ((17, 247), (324, 487), (563, 991)),
                ((17, 127), (204, 594), (670, 794), (871, 1192)),
                ((17, 101), (178, 340), (417, 719), (795, 854)),
            ),
            start=1,
        )
        for start, end in spans
    ),
    ("raiders", "raiders", 1, 0, -10),
    ("raiders", "raiders", 2, 10, -10),
    ("raiders", "raiders", 3, 10, -10),
    ("raiders", "raiders", 4, 10, None),
    ("monkeykingdom", "monkey", None, 40, 940),
    ("monkey-kingdom-eng", "monkey", None, 40, 940),
    ("life", "life", 1, 0, 366),
    ("life", "life", 2, 0, 338),
    ("life", "life", 3, 0, 370),
    ("life", "life", 4, 0, 405),
)
#: How datasets with names of their own call a run: dataset, task (null: any), first and last run, what stands
#: between the subject and the run, the number of the first run (null: always that of `fixed`; no run in the name if both are null),
#: fixed, and digits of the run in arrays and in other files. `{run+1}` is the run's successor.
NAMES = (
    ("bellaria", None, 1, 999, "_task-{task}", None, None, 0, 0),
    ("spacetop", "alignvideo", 1, 4, "_ses-01_task-alignvideo_acq-mb8", 1, None, 2, 2),
    ("spacetop", "alignvideo", 5, 8, "_ses-02_task-alignvideo_acq-mb8", 5, None, 2, 2),
    ("spacetop", "alignvideo", 9, 11, "_ses-03_task-alignvideo_acq-mb8", 9, None, 2, 2),
    ("spacetop", "alignvideo", 12, 13, "_ses-04_task-alignvideo_acq-mb8", 12, None, 2, 2),
    ("raiders", "raiders", 1, 999, "_ses-raiders_task-movie", 1, None, 2, 1),
    ("raiders", "actions", 1, 4, "_ses-actions1_task-actions", 1, None, 2, 1),
    ("raiders", "actions", 5, 8, "_ses-actions2_task-actions", 5, None, 2, 1),
    ("hca", None, 1, 999, "_ses-V1_task-{task}", 1, None, 2, 2),
    ("monkey-action", None, 1, 999, "_ses-actions_task-{task}", 1, None, 2, 2),
    ("whiplash-c1", "whiplash", 1, 1, "_ses-3_task-movie", None, 2, 2, 1),
    ("whiplash-c2", "whiplash", 1, 2, "_ses-{run+1}_task-movie", None, 2, 2, 2),
    ("whiplash-c3", "whiplash", 1, 1, "_task-video", None, 1, 2, 2),
    ("whiplash-c3", "localizer", 1, 999, "_task-localizer", None, 1, 2, 2),
    ("hybr", None, 1, 999, "_task-{task}", 1, None, 2, 2),
)
#: The files of a run's confounds - matrix, named columns, kept time points - and of its design.
CONFOUNDS = ("_desc-confounds_timeseries.npy", "_desc-confounds_timeseries.tsv", "_desc-mask_timeseries.npy")
DESIGN = "_design.json"


def datasets(spark: SparkSession) -> DataFrame:
    """A row for each dataset; tasks are a list, subjects the number of fixed ones (null where a table has them), conditions a list."""
    rows = [(*d, len(SUBJECTS[d[0]][1].split()) if d[0] in SUBJECTS else None, list(CONDITIONS.get(d[0], ()))) for d in DATASETS]
    return spark.createDataFrame(rows, f"{COLUMNS}, subjects int, conditions array<string>").withColumn("tasks", F.split("tasks", " "))


def subjects(spark: SparkSession, name: str | None = None) -> DataFrame:
    """(dataset, set, subject) of the fixed subjects; their set is `all`, besides the named ones."""
    known = {(d, "all"): s for d, s in SUBJECTS.items()} | SUBJECT_SETS
    rows = [(d, kind, head + s) for (d, kind), (head, tail) in known.items() if name in (None, d) for s in tail.split()]
    return spark.createDataFrame(rows, "dataset string, set string, subject string")


def intervals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTERVALS, "dataset string, task string, run int, start int, end int")


def file_names(runs: DataFrame, suffix: str = ".npy") -> DataFrame:
    """runs(dataset, subject, task, run, ...) with the file `name` of each.

    Datasets without names of their own have one pattern. A task or run that a dataset with names of its own does not have
    raises, when rows are made.
    """
    spark = runs.sparkSession
    table = spark.createDataFrame(NAMES, "own string, of string, low int, high int, middle string, first int, fixed int, digits int, other int")
    on = (F.col("dataset") == F.col("own")) & (F.col("of").isNull() | (F.col("of") == F.col("task"))) & F.col("run").between(F.col("low"), F.col("high"))
    placed = runs.join(F.broadcast(table), on, "left")
    own = F.col("dataset").isin(*sorted({n[0] for n in NAMES}))
    number = F.coalesce(F.col("run") - F.col("first") + 1, F.col("fixed")).cast("string")
    # Arrays of the default pattern have two digits, and so have its designs; its confounds have the bare number.
    digits = F.when(F.col("own").isNotNull(), F.col("digits") if suffix == ".npy" else F.col("other")).otherwise(F.lit(1 if suffix in CONFOUNDS else 2))
    number = F.when(F.col("own").isNull(), F.col("run").cast("string")).otherwise(number)
    padded = F.when(F.length(number) >= digits, number).otherwise(F.lpad(number, 2, "0"))
    middle = F.replace(F.replace(F.coalesce("middle", F.lit("_task-{task}")), F.lit("{task}"), F.col("task")), F.lit("{run+1}"), (F.col("run") + 1).cast("string"))
    name = F.concat(F.lit("sub-"), "subject", middle, F.coalesce(F.concat(F.lit("_run-"), padded), F.lit("")), F.lit(suffix))
    unknown = F.raise_error(F.concat(F.lit("no name for task "), "task", F.lit(" run "), F.col("run").cast("string"), F.lit(" of "), "dataset"))
    return placed.select(*[F.col(c) for c in runs.columns], F.when(own & F.col("own").isNull(), unknown).otherwise(name).alias("name"))
