"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as ``bytes.split()`` and ``[\x20\x09-\x0D]`` see it.
SPACE = " \t\n\x0b\x0c\r"
#: A word, as a pattern.
WORD = "[^\\x20\\x09-\\x0D]+"
TOKENIZER_FILE = "word_bpe_49k.json"
#: Bytes of a batch that goes to a Python worker, and of a row group of an intermediate table.
BATCH, ROW_GROUP = 4 << 20, 16 << 20

_made: dict[str, list[str]] = defaultdict(list)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share; ``clean`` removes it.

    Only a local session that names no such folder (a test) gets one of its own, which goes when the
    process ends; on a cluster the setting must be there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made[spark.sparkContext.applicationId].append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read it back.

    Lost executors then cost a re-read, not a recomputation.  Row groups are small, so a task holds
    little of what it writes; that the rows fit the schema is known, so the files aren't asked for it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders, wherever they lie."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def done_with(*frames: DataFrame) -> None:
    """Delete the folders of ``stored`` tables that no later plan reads."""
    for df in frames:
        remove(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def clean(spark: SparkSession) -> None:
    """Delete every folder that this application's operators made; their results must have been written before."""
    remove(spark, *_made.pop(spark.sparkContext.applicationId, []))


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that the session sends to Python workers, unless they are smaller already.

    The default is 64 MB a batch, several times which a task holds on both sides; the setting stays, since
    results are computed after an operator has returned.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < held <= BATCH:
        spark.conf.set(name, f"{BATCH}b")


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` has at most ``most`` bytes in each, or one row.

    At the end the worker gives back what it freed: it may idle beside other tasks for a while.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64"))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL(None).malloc_trim(0)


def hold(most: int = 64 << 20) -> None:
    """Keep up to so many freed bytes until ``trim``: arrays made again at every step then cost no new pages."""
    with contextlib.suppress(OSError, AttributeError):
        set_to = ctypes.CDLL(None).mallopt
        set_to(-1, most)  # M_TRIM_THRESHOLD
        set_to(-3, most // 4)  # M_MMAP_THRESHOLD


def column(name: str) -> Column:
    """The column of that name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def located(docs: DataFrame, **named: str) -> DataFrame:
    """The named columns under new names, then x_file and x_row: where a row's content lies.

    ``docs`` must be a plain file scan.  Nothing else is carried along, so no column of it can clash.
    """
    at = docs.metadataColumn("_metadata")
    return docs.select(*[column(c).alias(n) for n, c in named.items()], at["file_path"].alias("x_file"), at["row_index"].alias("x_row"))


def placed(docs: DataFrame, rows: DataFrame, *more: str) -> DataFrame:
    """The rows of a plain file scan that ``rows`` names by x_file and x_row, with its columns ``more``.

    Columns of ``docs`` keep their names and order; those of ``more`` follow, renamed where they would clash.
    """
    file, row, *rest = names = free(docs, "x_file", "x_row", *more)
    at = docs.metadataColumn("_metadata")
    full = docs.select("*", at["file_path"].alias(file), at["row_index"].alias(row))
    named = rows.select(*[F.col(a).alias(b) for a, b in zip(("x_file", "x_row", *more), names, strict=True)])
    return full.join(named, [file, row], "inner" if more else "left_semi").select(*columns(docs), *[F.col(c) for c in rest])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, though a lambda in ``body`` reads it often."""
    return F.transform(F.array(value), body)[0]


def id_bucket(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def id_bucket_column(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus
