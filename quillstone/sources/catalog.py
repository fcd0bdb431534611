"""The parsed tables of a folder, kept as Parquet; a refresh parses only notes whose time or size changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources import markdown as M
from quillstone.streaming.incremental import listing_diff


class Catalog:
    """note_table() of a folder under `base`, one version a folder; `current` names the one in use."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.current = spark, base.rstrip("/"), None

    def notes(self) -> DataFrame:
        return self.spark.read.parquet(self.current)

    def _put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/notes-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.current = path
        return self.notes()

    def open(self, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
        return self._put(M.note_table(M.read_folder(self.spark, root, excluded)))

    def refresh(self, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
        """path, op of what changed since; the tables follow."""
        if self.current is None:
            self.open(root, excluded)
            return self.notes().select("path", F.lit("new").alias("op"))
        files, old = M.read_folder(self.spark, root, excluded).where("is_note"), self.notes()
        path = f"{self.base}/changes-{uuid.uuid4().hex}"
        listing_diff(old.select("path", "mtime", "size"), files.select("path", "mtime", "size")).write.parquet(path)
        changes = self.spark.read.schema("path string, op string").parquet(path)
        parsed = M.note_table(files.join(changes.where("op <> 'deleted'").select("path"), "path", "left_semi"))
        self._put(old.join(changes, "path", "left_anti").unionByName(parsed))
        return changes


def by_kind(files: DataFrame) -> DataFrame:
    """kind, n: notes, canvases, view files, images and the rest."""
    kind = F.when(F.col("is_note"), "note").when(F.col("ext") == "canvas", "canvas").when(F.col("ext") == "base", "view").when(F.col("ext").isin("png", "jpg", "jpeg", "gif", "svg", "webp", "bmp"), "image").otherwise("other")
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
