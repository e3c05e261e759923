"""What several operators of this subpackage share: reading tables, words, hashes and Arrow batches inside tasks."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, StructType

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same for Java's regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: A-Z and a-z: only these change when a text is lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_lower = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: What tasks remember only to save work (texts and segments that they have met) is forgotten beyond so many entries.
MOST_KNOWN = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only on a single machine (a local master), where it is unset, a temporary folder stands in; a cluster must name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[\d*, ]+\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder, so that neither its lineage nor its work is repeated."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased on demand; none for null.

    bytes.split() splits at just the bytes 20 and 09-0D, which occur in no longer UTF-8 sequence.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.translate(_lower) if lower else data).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: A 64-bit value for each byte, and the multiplier from one place of a word to the next.
_BYTE_VALUES = np.where(_IS_SPACE, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
_STEP = np.uint64(0xD1342543DE82EF95)


def hashes_of_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of data begins, and its 64-bit hash: a polynomial of its bytes, scrambled, equal on every executor."""
    raw = np.frombuffer(data, np.uint8)
    gap = _IS_SPACE[raw]
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    lengths = np.diff(np.append(starts, len(raw)))  # with the gap after the word, whose bytes have value 0
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _STEP))
    return starts, mix(np.add.reduceat(_BYTE_VALUES[raw[starts[0] :]] * powers[place], starts - starts[0]))


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, in order, and the number of words of each text.

    All texts are hashed in a few passes over their joined bytes.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join([*data, b""])
    starts, hashes = hashes_of_words(joined.translate(_lower) if lower else joined)
    edges = np.cumsum([0, *(len(x) + 1 for x in data)])
    return hashes, np.diff(np.searchsorted(starts, edges))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k neighbours of h (hashes themselves), in order; empty if there are fewer.

    The run's hashes are added up with an odd multiplier for each place and scrambled.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i, c in enumerate(mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)):
        out += h[i : i + n] * c
    return mix(out)


def arrow_type(kind: DataType) -> pa.DataType:
    if isinstance(kind, ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}[kind.simpleString()]


def map_columns(df: DataFrame, fn: Callable[..., tuple | None], schema: str, rows: int = 512, chars: int = 4_000_000, size_of: int | None = None) -> DataFrame:
    """df with its rows replaced by fn's: inside tasks, fn gets slices of the columns as lists and returns lists.

    A slice holds at most `rows` rows and, if size_of names the place of a text column, some `chars` characters, so
    memory does not depend on how long the texts are. fn is called with the task's slices in order.
    """
    fields = StructType.fromDDL(schema).fields
    kinds = [(f.name, arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema(kinds)
        for batch in batches:
            for a, b in slices(batch, rows, chars, size_of):
                got = fn(*(c.to_pylist() for c in batch.slice(a, b - a).columns))
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(got, kinds, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int, chars: int, size_of: int | None) -> Iterator[tuple[int, int]]:
    """Bounds of the pieces into which a batch is cut."""
    if size_of is None:
        for a in range(0, batch.num_rows, rows):
            yield a, min(a + rows, batch.num_rows)
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(size_of)), 0).to_pylist()
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and (i - a >= rows or total + n > chars):
            yield a, i
            a, total = i, 0
        total += n
    if batch.num_rows:
        yield a, batch.num_rows
