"""A person's surface turned onto the template's: resampled by the registered sphere, then rotated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import surfaces
from ..sources.arrays import files
from . import mesh


@dataclass(frozen=True)
class Aligner:
    """sphere and anatomy have the same vertices; catalog has the template's geometry."""

    sphere: mesh.Mesh
    anatomy: mesh.Mesh
    hemi: str
    kind: str = "pial"

    @classmethod
    def of_files(cls, spark: SparkSession, sphere: str, anatomy: str, hemi: str, kind: str) -> Aligner:
        return cls(*[mesh.Mesh(m.vertices.drop("mesh"), m.faces.drop("mesh")) for m in (surfaces.read_meshes(spark, p) for p in (sphere, anatomy))], hemi, kind)

    @classmethod
    def from_freesurfer(cls, spark: SparkSession, folder: str, hemi: str, kind: str = "pial") -> Aligner:
        folder = folder.rstrip("/") if folder.rstrip("/").endswith("surf") else f"{folder.rstrip('/')}/surf"
        return cls.of_files(spark, f"{folder}/{hemi}h.sphere.reg", f"{folder}/{hemi}h.{kind}", hemi, kind)

    @classmethod
    def from_fmriprep(cls, spark: SparkSession, folder: str, hemi: str, kind: str = "pial") -> Aligner:
        """The registered sphere and the surface below the one anat folder; raises if there is not exactly one of each."""
        found = files(spark, folder, f"*_hemi-{hemi.upper()}_*.surf.gii").select("path").where(F.col("path").contains("/anat/"))
        wanted = (f"_hemi-{hemi.upper()}_space-fsaverage_desc-reg_sphere.surf.gii", f"_hemi-{hemi.upper()}_{kind}.surf.gii")
        paths = [[r["path"] for r in found.where(F.col("path").endswith(w)).limit(2).collect()] for w in wanted]
        if any(len(p) != 1 for p in paths):
            raise RuntimeError(f"not one sphere and one {kind} surface below {folder}")
        return cls.of_files(spark, paths[0][0], paths[1][0], hemi, kind)

    def run(self, sphere: DataFrame, template: DataFrame) -> DataFrame:
        """(v, x, y, z) of the template's vertices: the surface at the places of sphere(v, x, y, z), centred and turned onto template(v, x, y, z)."""
        weights = mesh.interpolation(mesh.Mesh(mesh.sphere(self.sphere.vertices), self.sphere.faces), mesh.sphere(sphere).withColumnRenamed("v", "p"))
        placed = weights.join(self.anatomy.vertices.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v"))
        resampled = placed.agg(*[F.sum(F.col(k) * F.col("w")).alias(k) for k in "xyz"])
        return mesh.rotated(resampled, mesh.rotation(resampled, template))
