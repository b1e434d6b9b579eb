"""Tables of datasets: where a run's signals, confounds and designs lie, anatomy by space, and how runs are put together.

Stored layout (every token is a partition column): signal by dataset, version, space, hemi, resample, task, subject, run;
confounds, confounds_named, kept and design by dataset, version, task, subject, run; contrasts by these and space, hemi,
resample, prep and kind; anatomy by dataset, version, space, which, subject and hemi. Of all datasets together: morphometry,
parcellations, masks and geometry by space, which, hemi and group; neighborhoods by space, center_space and hemi. A token
that a stored table lacks is not asked for.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prep, spaces
from . import datasets as known
from .scratch import written

SURFACES = ("fsavg-ico32", "fsavg-ico48", "fsavg-ico64", "onavg-ico32", "onavg-ico48", "onavg-ico64")
VOLUMES = ("mni-2mm", "mni-3mm", "mni-4mm")
#: What anatomy there is.
MEASURES = ("area", "area.mid", "area.pial", "curv", "curv.pial", "jacobian_white", "sulc", "thickness", "volume")
PARCELLATIONS = ("aparc", "aparc.DKTatlas", "aparc.a2009s")
SPACE, GROUP = "onavg-ico32", "on1031_trimmed"


def surface_or_volume(space: Column, resample: Column, hemi: Column) -> Column:
    """By the space, then by the resampling, then by whether a hemisphere is named."""
    kind = F.when(space.isin(*SURFACES), "surface").when(space.isin(*VOLUMES), "volume")
    kind = kind.when(resample.contains("pial") | resample.contains("nnfr") | resample.startswith("msm"), "surface").when(resample.contains("linear") | resample.contains("fmriprep"), "volume")
    return kind.when(hemi.isin("l", "r", "lr", "l-cerebrum", "r-cerebrum"), "surface").otherwise("volume")


def kind_of_space(space: str | None, resample: str | None, hemi: str) -> str:
    """surface_or_volume() for names at hand."""
    if space in SURFACES or space in VOLUMES:
        return "surface" if space in SURFACES else "volume"
    if resample:
        for part, kind in (("pial", "surface"), ("nnfr", "surface"), ("msm", "surface"), ("linear", "volume"), ("fmriprep", "volume")):
            if part in resample:
                return kind
    return "surface" if hemi in ("l", "r", "lr", "l-cerebrum", "r-cerebrum") else "volume"


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"no {what} is called {value}")
    return value


class Catalog:
    """Tables below a root; a name is a directory of Parquet partitioned by the tokens above."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str, on_missing: str = "raise", **where) -> DataFrame | None:
        """The table's rows where partition columns have the given values (lists: any of them); prunes partitions.

        on_missing is raise, warn or ignore, for a table that does not exist.
        """
        if on_missing not in ("raise", "warn", "ignore"):
            raise ValueError("on_missing is raise, warn or ignore")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            if on_missing == "raise":
                raise RuntimeError(f"no table {name} below {self.root}")
            if on_missing == "warn":
                warnings.warn(f"no table {name} below {self.root}", stacklevel=2)
            return None
        df = self.spark.read.parquet(f"{self.root}/{name}")
        for column, value in where.items():
            if value is not None and column in df.columns:
                df = df.where(F.col(column).cast("string").isin(*map(str, value)) if isinstance(value, list | tuple) else F.col(column).cast("string") == str(value))
        return df

    def write(self, df: DataFrame, name: str, by: list[str], mode: str = "append") -> None:
        df.write.mode(mode).partitionBy(*by).parquet(f"{self.root}/{name}")

    def dataset(self, name: str, **options) -> Dataset:
        name = known.ALIASES.get(name, name)
        row = next((d for d in known.DATASETS if d[0] == name), None)
        if row is None:
            raise ValueError(f"no dataset is called {name}")
        return Dataset(self, *row[:8], tuple(row[8].split()), **options)

    # Anatomy of a group of people, by space

    def morphometry(self, which: str, hemi: str, space: str = SPACE, group: str = GROUP, resample: str = "overlap-8div") -> DataFrame:
        """(v, x)"""
        return self.table("morphometry", space=space, which=one_of(which, MEASURES, "measure"), hemi=hemi, group=group, resample=resample).select("v", "x")

    def parcellation(self, which: str, hemi: str, space: str = SPACE, prob: bool = False, group: str = GROUP, resample: str = "overlap-8div") -> DataFrame:
        """(v, label), or with prob (label, v, p)."""
        found = self.table("parcellations_prob" if prob else "parcellations", space=space, which=one_of(which, PARCELLATIONS, "parcellation"), hemi=hemi, group=group, resample=resample)
        return found.select("label", "v", "p") if prob else found.select("v", "label")

    def mask(self, hemi: str, space: str = SPACE, legacy: bool = False, which: str = "aparc.a2009s", group: str = GROUP, resample: str = "overlap-8div") -> DataFrame:
        """(v, keep) of all vertices; for lr the right hemisphere's follow the left's. A legacy mask is that of the space's own template."""
        if hemi == "lr":
            left, right = (self.mask(h, space, legacy, which, group, resample) for h in "lr")
            return prep.both_hemispheres(left, right, left.count())
        if space == "MEBRAIN" or space.startswith("mkavg-ico"):
            which = group = "MEBRAIN"
        elif legacy:
            group = next(g for start, g in (("fsavg-ico", "fsaverage"), ("fslr-ico", "32k_fs_LR"), ("", None)) if space.startswith(start))
            if group is None:
                raise ValueError(f"{space} has no legacy mask")
        return self.table("masks", space=space, which=which, hemi=one_of(hemi, ("l", "r"), "hemisphere"), group=group, resample=resample).select("v", "keep")

    def geometry(self, which: str, hemi: str, space: str = SPACE, vertices_only: bool = False, group: str = GROUP):
        """A Mesh; faces alone for `faces`; or vertices alone. Both spheres are the registered one, which no group has averaged."""
        from ..operators.mesh import Mesh

        faces = None if vertices_only else self.table("faces", space=space, hemi=hemi).select("f", "a", "b", "c")
        if which == "faces":
            return self.table("faces", space=space, hemi=hemi).select("f", "a", "b", "c")
        ball = which in ("sphere", "sphere.reg")
        vertices = self.table("geometry", space=space, which="sphere.reg" if ball else which, hemi=hemi, **({} if ball else {"group": group})).select("v", "x", "y", "z")
        return vertices if vertices_only else Mesh(vertices, faces)

    def searchlights(self, hemi: str, radius: float, space: str = SPACE, center_space: str | None = None, mask: DataFrame | bool | None = None, center_mask: DataFrame | bool | None = None) -> DataFrame:
        """(center, v, dist) of the neighborhoods of a radius, from the stored ones of the largest radius. A mask of True is the space's own."""
        stored = self.table("neighborhoods", space=space, center_space=center_space or space, hemi=hemi).select("center", "v", "dist")
        own = lambda m, s: self.mask(hemi, s) if m is True else None if m is False else m
        kept = own(mask, space)
        if center_space is None:
            centers = kept
        else:
            centers = own(mask if center_mask is None else center_mask, center_space)
        return spaces.searchlights(stored, radius, kept, centers)


@dataclass(frozen=True)
class Dataset:
    """A dataset's tables. Space, resampling, version and preparation can be set for all calls, or for one."""

    catalog: Catalog
    name: str
    stored: str
    surface_space: str
    volume_space: str | None
    surface_resample: str | None
    volume_resample: str | None
    version: str
    tr: float | None
    tasks: tuple[str, ...]
    preparation: str | Callable = "default"
    masked: bool = True
    slicer: Callable[[DataFrame, DataFrame, str], DataFrame] | None = None

    @property
    def conditions(self) -> tuple[str, ...]:
        return known.CONDITIONS.get(self.name, ())

    def subjects(self, which: str = "all") -> DataFrame:
        """(subject): fixed ones, or the lines of the list subject_sets/<which>.txt of the dataset below the catalog's root."""
        fixed = (self.name, which) in known.SUBJECT_SETS or which == "all" and self.name in known.SUBJECTS
        if fixed:
            return known.subjects(self.catalog.spark, self.name).where(F.col("set") == which).select("subject")
        return self.catalog.spark.read.text(f"{self.catalog.root}/{self.stored}/subject_sets/{which}.txt").select(F.col("value").alias("subject"))

    def file_names(self, runs: DataFrame, suffix: str = ".npy") -> DataFrame:
        """runs(subject, task, run) with `name`."""
        return known.file_names(runs.withColumn("dataset", F.lit(self.name)), suffix).drop("dataset")

    def _space(self, hemi: str, space: str | None, resample: str | None, force_volume: bool = False) -> tuple[str, str | None, str | None]:
        kind = "volume" if force_volume else kind_of_space(space, resample, hemi)
        own = (self.surface_space, self.surface_resample) if kind == "surface" else (self.volume_space, self.volume_resample)
        return kind, space or own[0], resample or own[1]

    def _run(self, task: str, subject, run, version: str | None) -> dict:
        return {"dataset": self.name, "version": version or self.version, "task": task, "subject": subject, "run": run}

    def signal(self, task: str, hemi: str = "lr", subject=None, run=None, space: str | None = None, resample: str | None = None, version: str | None = None, force_volume: bool = False, n_left: int | None = None) -> DataFrame:
        """(subject, run, t, v, x); for lr the right hemisphere's vertices follow the left's n_left."""
        _, space, resample = self._space(hemi, space, resample, force_volume)
        rows = self.catalog.table("signal", **self._run(task, subject, run, version), space=space, resample=resample, hemi=list(hemi) if hemi == "lr" else hemi)
        if hemi == "lr":
            if n_left is None:
                top = rows.where("hemi = 'l'").agg(F.max("v")).first()[0]
                n_left = 0 if top is None else top + 1
            rows = rows.withColumn("v", F.when(F.col("hemi") == "r", F.col("v") + n_left).otherwise(F.col("v")))
        return rows.select("subject", "run", "t", "v", "x")

    def confounds(self, task: str, subject=None, run=None, version: str | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """(subject, run, t, c array) of the regressors; the named columns; (subject, run, t, keep) of the time points to keep. hca has the first alone."""
        where = self._run(task, subject, run, version)
        matrix = self.catalog.table("confounds", **where).select("subject", "run", "t", "c")
        if self.name == "hca":
            return matrix, None, None
        named, kept = (self.catalog.table(n, on_missing="ignore", **where) for n in ("confounds_named", "kept"))
        return matrix, named, kept.select("subject", "run", "t", "keep") if kept is not None else None

    def design(self, task: str, subject=None, run=None, version: str | None = None) -> DataFrame:
        return self.catalog.table("design", **self._run(task, subject, run, version))

    def contrasts(self, task: str, hemi: str, kind: str = "t", subject=None, run=None, space: str | None = None, resample: str | None = None, preparation: str | None = None, version: str | None = None, force_volume: bool = False) -> DataFrame:
        """(subject, run, contrast, v, x)"""
        _, space, resample = self._space(hemi, space, resample, force_volume)
        return self.catalog.table("contrasts", **self._run(task, subject, run, version), space=space, resample=resample, hemi=hemi, prep=preparation or self.preparation, kind=kind).select("subject", "run", "contrast", "v", "x")

    def _anatomy(self, which: str, hemi: str, subject, mask, space: str | None, version: str | None) -> DataFrame:
        space = space or self.surface_space
        found = self.catalog.table("anatomy", dataset=self.name, version=version or self.version, space=space, which=which, subject=subject, hemi=hemi).select("subject", "v", "x")
        mask = self.catalog.mask(hemi, space) if mask is True else mask or None
        return found if mask is None else prep.masked(found, mask)

    def morphometry(self, which: str, hemi: str, subject=None, mask: DataFrame | bool | None = True, space: str | None = None, version: str | None = None) -> DataFrame:
        """(subject, v, x) of people's own measures."""
        return self._anatomy(which, hemi, subject, mask, space, version)

    def parcellation(self, which: str, hemi: str, subject=None, mask: DataFrame | bool | None = True, space: str | None = None, version: str | None = None) -> DataFrame:
        return self._anatomy(which + ".annot", hemi, subject, mask, space, version)

    def spans(self, signal: DataFrame, task: str) -> DataFrame | None:
        """(subject, run, start, end) of the time points kept, by each run's own length; null if all are."""
        spans = known.intervals(signal.sparkSession).where((F.col("dataset") == self.name) & (F.col("task") == task))
        if not spans.limit(1).count():
            return None
        lengths = signal.groupBy("subject", "run").agg((F.max("t") + 1).alias("n"))
        each = lengths.join(F.broadcast(spans.withColumnRenamed("run", "of")), F.col("of").isNull() | (F.col("of") == F.col("run")), "left")
        known_run = F.when(F.col("start").isNull(), F.raise_error(F.concat(F.lit(f"{self.name} {task} has no run "), F.col("run").cast("string")))).otherwise(F.col("start"))
        end = F.when(F.col("end").isNull(), F.col("n")).when(F.col("end") < 0, F.col("n") + F.col("end")).otherwise(F.least("end", "n"))
        return each.select("subject", "run", known_run.alias("start"), end.alias("end"))

    def kept(self, table: DataFrame, task: str, signal: DataFrame | None = None) -> DataFrame:
        """The time points of a table(subject, run, t, ...) that the dataset keeps; lengths are those of signal, if another table."""
        if self.slicer is not None:
            return self.slicer(table, table if signal is None else signal, task)
        spans = self.spans(table if signal is None else signal, task)
        return table if spans is None else prep.sliced(table, spans)

    def data(self, task: str, hemi: str = "lr", subject=None, run=None, space: str | None = None, resample: str | None = None, mask: DataFrame | bool | None = None, preparation: str | Callable | None = None, version: str | None = None, force_volume: bool = False, prep_options: dict | None = None, concat: bool = True) -> DataFrame:
        """Scan, cut, prepare each run, and put runs one after the other: (subject, t, v, x), or with the run if not concat.

        Signals and all tables of confounds are cut at the same time points. On a surface the space's mask is applied, unless mask is
        False or another one. preparation is a name, or a function of (signal, confounds, kept time points, mask).
        """
        kind, space, resample = self._space(hemi, space, resample, force_volume)
        raw = self.signal(task, hemi, subject, run, space, resample, version, force_volume)
        matrix, _, keep = self.confounds(task, subject, run, version)
        # Preparation reads each of them several times: written once, the cuts and joins before are not done again.
        signal, matrix, keep = (None if x is None else written(self.catalog.spark, self.kept(x, task, raw), "cut") for x in (raw, matrix, keep))
        if mask is None or mask is True:
            mask = self.catalog.mask(hemi, space) if kind == "surface" and (self.masked or mask) else None
        mask = None if mask is False else mask
        preparation = preparation or self.preparation
        if callable(preparation):
            prepared = preparation(signal, matrix, keep, mask)
        else:
            more = {"keep": keep} if preparation.startswith("scrub") else {}
            prepared = prep.get_prep(preparation, **(prep_options or {}))(signal, matrix, mask=mask, **more)
            prepared = prep.renumbered(prepared) if more else prepared
        return prep.concatenated(prepared) if concat else prepared
