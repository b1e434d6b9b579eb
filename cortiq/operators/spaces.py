"""Masks, neighborhoods, distances, smoothing and space-to-space transforms as relations.

A transform is (src, dst, w); a neighborhood (center, v, dist); a mask (v, keep). Masked data is renumbered by rank among
the kept vertices, and both numbers are at hand.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The largest radius of neighborhoods, in mm.
MAX_RADIUS = 20
#: Vertices of the left and right hemisphere, the space they tell, and whether its mask was applied.
SIZES = (
    (154786, 154560, "onavg-ico128", True),
    (9675, 9666, "onavg-ico32", True),
    (9519, 9506, "fsavg-ico32", True),
    (9504, 9483, "fslr-ico32", True),
    (38698, 38628, "onavg-ico64", True),
    (38073, 38040, "fsavg-ico64", True),
    (38018, 37943, "fslr-ico64", True),
    (21779, 21731, "onavg-ico48", True),
    (30153, 30079, "fslr-ico57", True),
    (152, 151, "onavg-ico4", True),
    (603, 607, "onavg-ico8", True),
    (2417, 2414, "onavg-ico16", True),
    (9372, 9370, "fsavg-ico32", True),
    (10242, 10242, "onavg-ico32", False),
    (40962, 40962, "onavg-ico64", False),
    (23042, 23042, "onavg-ico48", False),
    (32492, 32492, "fslr-ico57", False),
    (162, 162, "onavg-ico4", False),
    (642, 642, "onavg-ico8", False),
    (2562, 2562, "onavg-ico16", False),
)


def guessed(left: int, right: int | None = None) -> tuple[str, bool, int]:
    """(space, masked, vertices of the left) from both hemispheres' sizes, or from their sum alone."""
    for a, b, space, masked in SIZES:
        if (left, right) == (a, b) or right is None and left == a + b:
            return space, masked, a
    raise ValueError(f"no space has {left}{'' if right is None else f' and {right}'} vertices")


def reindexed(mask: DataFrame, chunk: int = 4096) -> DataFrame:
    """(v, vm): the rank of each kept vertex, from 0, counted in chunks of vertex numbers so that no task sorts them all."""
    kept = mask.where("keep").select("v", F.floor(F.col("v") / chunk).alias("chunk"))
    sizes = kept.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    base = sizes.select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("chunk").orderBy("v")
    return kept.join(base, "chunk").select("v", (F.col("base") + F.row_number().over(inside) - 1).cast("long").alias("vm"))


def symmetric(distances: DataFrame, vertices: DataFrame) -> DataFrame:
    """(i, j, d) both ways and the zero diagonal, from i < j and the vertices(v)."""
    flipped = distances.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")
    diagonal = vertices.select(F.col("v").alias("i"), F.col("v").alias("j"), F.lit(0.0).alias("d"))
    return distances.select("i", "j", "d").unionByName(flipped).unionByName(diagonal)


def masked_pairs(pairs: DataFrame, source_mask: DataFrame | None = None, target_mask: DataFrame | None = None, source: str = "i", target: str = "j") -> DataFrame:
    """pairs whose ends are kept, renumbered; None leaves a side as it is."""
    for mask, column in ((source_mask, source), (target_mask, target)):
        if mask is not None:
            index = reindexed(mask).withColumnRenamed("v", column)
            pairs = pairs.join(index, column).withColumn(column, F.col("vm")).drop("vm")
    return pairs


def normalised(transform: DataFrame, keep_sum: bool = False) -> DataFrame:
    """Weights that sum to 1 for each target, or for each source with keep_sum; sums of zero give 0."""
    key = "src" if keep_sum else "dst"
    sums = transform.groupBy(key).agg(F.sum("w").alias("s"))
    return transform.join(sums, key).select("src", "dst", F.coalesce(F.try_divide("w", "s"), F.lit(0.0)).alias("w"))


def spread(fwhm: float | None = None, sigma: float | None = None) -> float:
    """What squared distances are divided by in the exponent of a Gaussian."""
    if (fwhm is None) == (sigma is None):
        raise ValueError("give fwhm or sigma")
    return fwhm**2 / (4 * math.log(2)) if fwhm is not None else 2 * sigma**2


def smoothing(distances: DataFrame, fwhm: float | None = None, sigma: float | None = None, keep_sum: bool = False) -> DataFrame:
    """Gaussian weights of distances(i, j, d), normalised; a width of 0 is the identity."""
    by = spread(fwhm, sigma)
    cells = distances.select(F.col("i").alias("src"), F.col("j").alias("dst"), "d")
    if by == 0:
        return cells.where("src = dst").select("src", "dst", F.lit(1.0).alias("w"))
    return normalised(cells.select("src", "dst", F.exp(-F.col("d") * F.col("d") / by).alias("w")), keep_sum)


def transposed(transform: DataFrame) -> DataFrame:
    return transform.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def nearest_only(transform: DataFrame) -> DataFrame:
    """One source of weight 1 for each target: the one of most weight, the first on ties."""
    best = transform.groupBy("dst").agg(F.min(F.struct((-F.col("w")).alias("w"), "src")).alias("b"))
    return best.select(F.when(F.col("b.w") < 0, F.col("b.src")).otherwise(0).alias("src"), "dst", F.lit(1.0).alias("w"))


def mapping(transform: DataFrame, nn: bool = False, keep_sum: bool = False, source_mask: DataFrame | None = None, target_mask: DataFrame | None = None) -> DataFrame:
    """A transform between (masked) spaces, reduced to the nearest source or normalised."""
    cells = masked_pairs(transform, source_mask, target_mask, "src", "dst")
    return nearest_only(cells) if nn else normalised(cells, keep_sum)


def applied(values: DataFrame, transform: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """values(keys, v, x) times a transform: (keys, v, x) of the targets. A product with missing (NaN) values is missing."""
    both = values.withColumnRenamed("v", "src").join(transform, "src")
    return both.groupBy(*keys, F.col("dst").alias("v")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))


def block_diagonal(left: DataFrame, right: DataFrame, n_src: int, n_dst: int) -> DataFrame:
    """The right hemisphere's transform after the left's."""
    return left.unionByName(right.select((F.col("src") + n_src).alias("src"), (F.col("dst") + n_dst).alias("dst"), "w"))


def searchlights(neighborhoods: DataFrame, radius: float, mask: DataFrame | None = None, center_mask: DataFrame | None = None) -> DataFrame:
    """(center, pos, v, dist): members within the radius (inclusive), renumbered by the masks, in the order of distance."""
    if radius > MAX_RADIUS:
        raise ValueError(f"neighborhoods reach {MAX_RADIUS} mm")
    near = neighborhoods.where(F.col("dist") <= radius)
    near = masked_pairs(near, center_mask, mask, "center", "v")
    order = Window.partitionBy("center").orderBy("dist", "v")  # a neighborhood: bounded by the radius
    return near.withColumn("pos", F.row_number().over(order) - 1)


def packed(neighborhoods: DataFrame) -> DataFrame:
    """(center, members array<struct<v, dist>>)"""
    return neighborhoods.groupBy("center").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v", "dist"))), lambda m: F.struct(m["v"].alias("v"), m["dist"].alias("dist"))).alias("members"))


def parcels_expanded(labels: DataFrame, values: DataFrame) -> DataFrame:
    """(v, x): each vertex's parcel value; NaN for labels of 0 and below, and for parcels without a value."""
    found = labels.join(values, "label", "left")
    return found.select("v", F.when(F.col("label") > 0, F.coalesce("x", F.lit(float("nan")))).otherwise(float("nan")).alias("x"))


def unmasked(values: DataFrame, mask: DataFrame) -> DataFrame:
    """(v, x) of all vertices: masked values(vm, x) at their place, NaN elsewhere."""
    placed = reindexed(mask).join(values, "vm", "left")
    return mask.select("v").join(placed.select("v", "x"), "v", "left").withColumn("x", F.coalesce("x", F.lit(float("nan"))))


def upsampled(values: DataFrame, transform: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(v, x) in the finer space of a transform: masked values(vm, x) are put in place first; NaN stays NaN."""
    return applied(values if mask is None else unmasked(values, mask), transform)


def parcellation(probabilities: DataFrame, transform: DataFrame) -> DataFrame:
    """(v, label): resampled probabilities(label, v, p), the most likely label (the first on ties), -1 for background 0."""
    resampled = applied(probabilities.withColumnRenamed("p", "x"), transform, ("label",))
    best = resampled.groupBy("v").agg(F.min(F.struct((-F.col("x")).alias("x"), "label")).alias("b"))
    return best.select("v", F.when(F.col("b.label") == 0, -1).otherwise(F.col("b.label")).alias("label"))


def with_background(parcels: DataFrame, vertices: DataFrame) -> DataFrame:
    """parcels(label, v, p) with label 0, of probability 0 everywhere, for each of vertices(v)."""
    return parcels.select("label", "v", "p").unionByName(vertices.select(F.lit(0).cast(dict(parcels.dtypes)["label"]).alias("label"), "v", F.lit(0.0).alias("p")))


def masks_differ(first: DataFrame, second: DataFrame) -> DataFrame:
    """(v) where two masks(v, keep) disagree, or where only one has the vertex."""
    both = first.join(second.withColumnRenamed("keep", "other"), "v", "full")
    return both.where(~F.col("keep").eqNullSafe(F.col("other"))).select("v")


def peaks_in(parcels: DataFrame, members: DataFrame) -> DataFrame:
    """(label, v, found): each parcel's likeliest vertex (the first on ties), and whether members(label, v) has it."""
    peaks = parcels.where("label > 0").groupBy("label").agg(F.min(F.struct((-F.col("p")).alias("p"), "v")).alias("b")).select("label", "b.v")
    return peaks.join(members.select("label", "v").distinct().withColumn("found", F.lit(True)), ["label", "v"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def vertex_count(ico: int) -> int:
    """Vertices of an icosahedron whose edges are divided by ico."""
    return 10 * ico * ico + 2
