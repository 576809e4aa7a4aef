"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.materialize import cut, few, release
from kvloom.shipping import ship

__all__ = ["WORD", "cut", "few", "given_names", "prepare", "release", "remainder", "slices", "table"]

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: What a batch of rows for a Python worker may hold; Spark's own default is 64 MB, several of which a worker would hold at a time.
BATCH, _BATCH_BYTES = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT = 64 << 20


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors, and keep batches of texts small unless the session says how large they may be."""
    ship(spark)
    if spark.conf.get(_BATCH_BYTES).rstrip("b") == str(_DEFAULT):
        spark.conf.set(_BATCH_BYTES, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def slices(n_rows: int, rows_each: int, least: int = 8) -> int:
    """How many hash slices keep each at about rows_each rows."""
    return max(least, -(-n_rows // rows_each))


def given_names(keep: tuple[str, ...], results: tuple[str, ...]) -> list[str]:
    """Names under which kept columns come back: their own, or with _given after it where a result has that name."""
    out: list[str] = []
    for c in keep:
        while c in results or c in out or c != keep[len(out)] and c in keep:
            c += "_given"
        out.append(c)
    return out
