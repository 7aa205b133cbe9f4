"""What the operators of this subpackage share: scratch tables in the shared folder, text expressions, files."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_libc = ctypes.CDLL(None)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: A word of these operators, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast up to this many bytes by its own count of rows.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; set here only where unset, and only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at if "://" in at or at.startswith("file:") else "file://" + at


def refuse_reserved(df: DataFrame) -> None:
    """Names beginning with ``__wg_``, in any case, are the operators' own; a caller's column of such a name is an error, not overwritten."""
    if own := [c for c in df.columns if c.lower().startswith("__wg_")]:
        raise ValueError(f"column names beginning with __wg_ are reserved: {own}")


def quoted(name: str) -> str:
    """The name as Spark reads it whole, whatever dots, blanks and backticks are in it."""
    return "`" + name.replace("`", "``") + "`"


def set_apart(df: DataFrame, needed: dict[str, str], added: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows under names that are safe to work with, and what gives callers their names back.

    ``needed`` maps an operator's names to the caller's, which are looked up as written and else without case. All
    other columns get numbered names by position, so dots, blanks, repeated names and any clash do no harm. Columns
    that equal one of the ``added`` names, without case as Spark compares them, are replaced, so they are left out.
    The second result takes a frame with these columns first and whatever was added behind them.
    """
    refuse_reserved(df)
    names, lower = df.columns, [c.lower() for c in df.columns]
    own = {}
    for name, of in needed.items():
        if of not in names and of.lower() not in lower:
            raise ValueError(f"no column {of} among {names}")
        own[names.index(of) if of in names else lower.index(of.lower())] = name
    kept = [i for i in range(len(names)) if i in own or lower[i] not in {a.lower() for a in added}]
    plain = [own.get(i, f"__wg_x{i}") for i in range(len(names))]
    apart = df.toDF(*plain).select(*[plain[i] for i in kept])
    return apart, lambda out: out.toDF(*[names[i] for i in kept], *out.columns[len(kept) :])


def scratch(spark: SparkSession, name: str) -> str:
    """A new place for one intermediate table; it belongs to the shared folder, whose owner clears it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to a table in the shared folder and reads them back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def maybe_broadcast(side: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The side, marked for broadcast if its counted rows take at most ``limit`` bytes; else Spark shuffles both sides.

    ``side`` should be a table already written, as it is counted here.
    """
    return F.broadcast(side) if side.count() * row_bytes <= limit else side


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which whoever runs the job sizes by the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_text(c: Column) -> Column:
    """crc32 of a number written as text."""
    return F.crc32(c.cast("string").cast("binary"))


def held(c: Column, mod: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves this remainder; an id that is null is never held out."""
    return F.coalesce(F.pmod(crc_text(c), F.lit(mod)) == rest, F.lit(False))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def tidy() -> None:
    """Gives memory that is free back to the system: Python workers stay for later tasks, and idle ones count, too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with equal keys, from a partition that is sorted by them. Holds one group at a time."""
    at, got = None, []
    for b in batches:
        cols = [b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]
        for i, key in enumerate(zip(*cols)):
            if key != at:
                if got:
                    yield at, got
                at, got = key, []
            got.append((b, i))
    if got:
        yield at, got
        del got
    tidy()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    tidy()


class WordHash(dict):
    """Word (bytes) to a 64-bit hash, remembered for up to ``limit`` words."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        v = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = v
        return v


def put_file(uri: str, data: bytes) -> None:
    """Writes a file in the shared store whole: under a name of this attempt first, then moved over the final name.

    A second attempt at the same task thus replaces the file by an equal one.
    """
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, path)


def get_file(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return f.read()
