"""Helpers shared by the corpus operators: shared scratch tables, Arrow batches and word splitting."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: What str.split() takes for blanks besides the six ASCII ones.
_MORE_BLANKS = "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_BLANKS = re.compile(f"[{_MORE_BLANKS}]")
_WORD = re.compile(r"[^ \t-\r]+")
#: Rows of one Arrow batch; whole texts can be long, so batches stay small.
BATCH_ROWS = 512
#: Bytes that a task should hold at once.
GROUP_BYTES = 32 << 20


def words_of(text: str | None) -> list[str]:
    """Words split at the six ASCII blanks only; str.split() splits at more, so such texts take the pattern."""
    if not text:
        return []
    return _WORD.findall(text) if _BLANKS.search(text) else text.split()


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, everything else unchanged."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, as one row may be a very long text."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names; where none is set, as in tests on one machine, a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spent(*tables: DataFrame) -> None:
    """Frees the disk of tables from written() that nothing reads any more, by writing them anew without rows."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


def released() -> None:
    """Hands memory that earlier tasks of this worker have freed back to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hash_order(column: str, seed: int = 0):
    """A fixed pseudo-random order of rows by a key."""
    return F.xxhash64(F.lit(seed), F.col(column))


def one_text(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The columns of ids and text, for a bounded number of ids: of rows that share an id, the one with the smallest hash of its text."""
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy(*ids.columns).agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))


def held_out(column: str = "doc_id"):
    """Rows never learnt from: crc32 of the id as text, modulo 5, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chunks(items: list, sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to about limit."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(items):
        yield start, len(items)
