"""Snapshots of an index as Parquet folders with a one-row manifest, and their validation on the way back."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import is_usable
from ..operators.maintenance import MOST_CHUNKS, still_valid, violations

# Fixed values.
VERSION, WIDTHS = 4, (256, 768)
VECTOR_FILE, MOST_ID_CHARS = "vectors.bin", 4096


def cache_key(workspace: str) -> str:
    return hashlib.sha256(workspace.encode()).hexdigest()[:24]


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    """Manifests of all whole snapshots, the last one last."""
    try:
        rows = spark.read.schema("n long, version int, generation string, updated_at string, width int").parquet(f"{path}/manifest*").collect()
    except Exception as x:  # nothing was saved yet
        if "PATH_NOT_FOUND" not in str(x):
            raise
        return []
    return sorted((r.asDict() for r in rows), key=lambda r: r["n"])


def save(path: str, chunks: DataFrame, files: DataFrame, vectors: DataFrame | None = None, width: int = 0, generation: str = "", updated_at: str = "") -> bool:
    """Write chunks, files and, if every chunk has a usable vector, vectors by width. Whether vectors were written.

    A snapshot is a numbered folder; its manifest, a file of a new name, is written last. So a failure leaves the one
    before as it was, and vectors of other widths stay with the snapshots that had them.
    """
    spark = chunks.sparkSession
    n = max((m["n"] for m in _manifests(spark, path)), default=-1) + 1
    folder = f"{path}/s{n}"
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    files.write.mode("overwrite").parquet(f"{folder}/files")
    ready = False
    if vectors is not None:
        usable = vectors.where(is_usable(F.col("vector"), width)).select("id", "vector").join(chunks.select("id", "hash"), "id")
        ready = usable.count() == chunks.count() > 0
        if ready:
            usable.write.mode("overwrite").parquet(f"{folder}/vectors")
    spark.createDataFrame([(n, VERSION, generation, updated_at, width if ready else 0)], "n long, version int, generation string, updated_at string, width int").coalesce(1).write.parquet(f"{path}/manifest{n}")
    return ready


def load(spark: SparkSession, path: str, generation: str = "", width: int = 0) -> tuple[DataFrame, DataFrame, DataFrame | None] | None:
    """chunks, files and vectors of the last snapshot; nothing if there is none or it breaks a rule.

    Vectors are of the last snapshot that had them in that width; those whose chunk has changed since are left out.
    """
    found = _manifests(spark, path)
    if not found:
        return None
    last = found[-1]
    manifest = spark.createDataFrame([(last["version"], last["generation"])], "version int, generation string")
    chunks, files = spark.read.parquet(f"{path}/s{last['n']}/chunks"), spark.read.parquet(f"{path}/s{last['n']}/files")
    if not violations(chunks, files, manifest, generation=generation).where("n > 0").isEmpty():
        return None
    held = [m["n"] for m in found if width and m["width"] == width]
    if not held:
        return chunks, files, None
    stored = spark.read.parquet(f"{path}/s{held[-1]}/vectors").where(is_usable(F.col("vector"), width))
    return chunks, files, still_valid(stored, stored.select("id", "hash"), chunks)


def vector_metadata(rows: DataFrame, version: int = VERSION) -> DataFrame:
    """Entries of a vector list that are sound: width, ids, hashes (null if none were kept), hash (of the vectors), file_name.

    A known width; ids that are short, told once, and no more than a snapshot may hold; as many hashes as ids; hashes that
    look like hashes; a file of a known name. Before version 4 there was one list, without a name.
    """
    d = rows if version >= 4 else rows.withColumn("file_name", F.lit(VECTOR_FILE))
    ids, named = F.col("ids"), F.col("file_name").isin(VECTOR_FILE) | (F.col("file_name") == F.concat(F.lit("vectors-"), F.col("width").cast("string"), F.lit("d.bin")))
    known = F.size(ids).between(0, MOST_CHUNKS) & F.forall(ids, lambda x: F.length(x).between(1, MOST_ID_CHARS)) & (F.size(F.array_distinct(ids)) == F.size(ids))
    hashed = F.col("hashes").isNull() | ((F.size("hashes") == F.size(ids)) & F.forall("hashes", lambda x: x.rlike("^[0-9a-fA-F]{16}$")))
    return d.where(F.col("width").isin(*WIDTHS) & known & hashed & F.col("hash").rlike("^[0-9a-fA-F]{64}$") & named)
