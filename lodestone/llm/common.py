"""Shared helpers of the training-data operators.

Python stages run as ``mapInArrow`` over column-pruned frames.  Arrow batches are
re-cut by bytes (``text_chunks``) so that a stage's memory follows a fixed byte
budget and not the number of rows that happen to share a batch.
"""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python stage holds at a time.
CHUNK_BYTES = 2 << 20

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of at most ``rows`` rows, so that long texts don't pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is set."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir() or at
    return at.rstrip("/")


class _Scopes(threading.local):
    """The open ``scratch`` blocks of a thread, innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCRATCH = _Scopes()


class scratch:
    """Tables that ``cut`` writes inside of the block are removed at its end, but for those of ``keep``.

    For steps whose results are written before the block ends.  The collector is asked to
    run too, so that the shuffle files of finished steps may go.
    """

    def __init__(self, spark: SparkSession, collect: bool = True) -> None:
        self.spark, self.collect = spark, collect

    def __enter__(self) -> scratch:
        _SCRATCH.open.append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a table that outlives the block (it belongs to the block around it)."""
        mine = _SCRATCH.open.pop()
        try:
            return cut(df)
        finally:
            _SCRATCH.open.append(mine)

    def __exit__(self, *error: object) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for at in _SCRATCH.open.pop():
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        if self.collect:
            gc.collect()
            jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    if _SCRATCH.open:
        _SCRATCH.open[-1].append(at)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), vectorised."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= MIX1
        x ^= x >> np.uint64(27)
        x *= MIX2
        x ^= x >> np.uint64(31)
    return x


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lens) // limit
        edges = np.flatnonzero(np.diff(block)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


_CACHES: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Called by a Python stage that keeps a cache in its worker: other stages' caches go, so that a worker holds one at most."""
    for other in [o for o in _CACHES if o != owner]:
        _CACHES.pop(other)()
        pa.default_memory_pool().release_unused()
    _CACHES[owner] = clear


class WordHash(dict):
    """word -> stable 64-bit hash (xxh3 where present); bounded by ``trim``."""

    LIMIT = 400_000

    def __init__(self) -> None:
        import xxhash

        self.of = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = self[word] = self.of(word)
        return h

    def trim(self) -> None:
        if len(self) > self.LIMIT:
            self.clear()


_WORD_HASH: list[WordHash] = []


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, and where each text's words start (with the end).

    ``bytes.split`` cuts at exactly those six ASCII characters, and ``bytes.lower``
    changes A-Z alone.
    """
    if not _WORD_HASH:
        _WORD_HASH.append(WordHash())
    claim("words", _WORD_HASH.clear)
    known = _WORD_HASH[0]
    known.trim()
    starts, parts = [0], []
    for text in texts:
        words = (text.lower() if lower else text).split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        starts.append(starts[-1] + len(words))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(starts, np.int64)


def shingle_hashes(words: np.ndarray, starts: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows of each text in order, and where each text's start.

    With ``short`` a text with fewer words gives its whole word sequence as one
    shingle; without words it gives none.
    """
    with np.errstate(over="ignore"):
        n = np.diff(starts)
        if not len(words):
            return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled += mix64(words[k : len(words) - width + 1 + k] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
        rolled = mix64(rolled)
        counts = np.maximum(n - width + 1, 0)
        own = np.repeat(np.arange(len(n)), counts)
        first = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(first[-1]) - first[own] + starts[own]
        out = rolled[at] if len(at) else np.zeros(0, np.uint64)
        tiny = np.flatnonzero((n > 0) & (n < width)) if short else []
        if len(tiny):
            whole = []
            for d in tiny:
                h = np.uint64(len(words[starts[d] : starts[d + 1]]))
                for w in words[starts[d] : starts[d + 1]]:
                    h = mix64(np.array([h * np.uint64(31) + w], np.uint64))[0]
                whole.append(h)
            out = np.insert(out, first[tiny], np.array(whole, np.uint64))
            counts = counts.copy()
            counts[tiny] = 1
            first = np.concatenate([[0], np.cumsum(counts)])
    return out, first


def bounded_broadcast(small: DataFrame, limit_rows: int) -> DataFrame:
    """Broadcast ``small`` only where a count proves it has at most ``limit_rows`` rows; otherwise leave it to the planner."""
    return F.broadcast(small) if small.limit(limit_rows + 1).count() <= limit_rows else small


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long links -> (node, component) with component the smallest node reachable.

    Alternates large-star and small-star steps: each is one aggregation for the
    minimum and one join of written tables, both by node, so that a hub's links are
    pre-aggregated and its join side can be split.  Every round is written to the shared folder;
    links never reach the driver, only their count and a checksum do.
    """
    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    spark = edges.sparkSession
    e = cut(
        edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    last = stamp(e)
    for _ in range(max_rounds):
        with scratch(spark, collect=False) as step:
            e = step.keep(_round(e))
        now = stamp(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("connected components did not converge")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _round(e: DataFrame) -> DataFrame:
    """A large-star and a small-star step over links (u, v), u > v."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    large = cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
    small = (
        large.join(low, "u")
        .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .filter("u != v")
        .distinct()
    )
    return small.filter("u > v")


def map_groups(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn(columns: dict of numpy arrays) -> list of arrays`` for each group of ``keys``, streamed.

    Rows are dealt and sorted by the keys, and many small groups share a batch; list
    columns come as (values, offsets).  A group must fit in memory: callers split it.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _grouped(batches, names, keys, fn, [f.strip().split()[0] for f in schema.split(",")])

    return dealt.mapInArrow(run, schema)


#: Rows of results that are handed on together.
TOGETHER = 4096


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str], keys: list[str], fn, out_names: list[str]) -> Iterator[pa.RecordBatch]:
    """Results of ``fn`` for the groups of sorted batches.  Groups inside of a batch are slices of its columns, converted once."""

    def converted(a: pa.Array) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        if not pa.types.is_list(a.type):
            return a.to_numpy(zero_copy_only=False)
        return a.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)

    def part(c: np.ndarray | tuple[np.ndarray, np.ndarray], lo: int, hi: int) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        if isinstance(c, tuple):
            return c[0][c[1][lo] : c[1][hi]], c[1][lo : hi + 1] - c[1][lo]
        return c[lo:hi]

    made: list[pa.RecordBatch] = []

    def put(cols: dict) -> Iterator[pa.RecordBatch]:
        out = fn(cols)
        if out is not None:
            made.append(pa.RecordBatch.from_arrays(out, out_names))
            if sum(m.num_rows for m in made) >= TOGETHER or len(made) >= 256:
                yield from given()

    def given() -> Iterator[pa.RecordBatch]:
        if made:
            together = pa.Table.from_batches(made).combine_chunks().to_batches()
            made.clear()
            yield from together

    def held_columns(held: list[pa.RecordBatch]) -> dict:
        piece = pa.Table.from_batches(held)
        return {c: converted(piece.column(c).combine_chunks()) for c in names}

    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in codes:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in codes)
        new[0] = last is not None and first != last
        last = tuple(c[-1] for c in codes)
        at = 0
        whole: dict | None = None
        # a column with nulls may have another type in a slice without
        sliced = not any(batch.column(c).null_count and not pa.types.is_list(batch.column(c).type) for c in names)
        for edge in np.flatnonzero(new).tolist():
            if held or not sliced:
                if edge > at:
                    held.append(batch.slice(at, edge - at))
                if held:
                    yield from put(held_columns(held))
            elif edge > at:
                if whole is None:
                    whole = {c: converted(batch.column(c)) for c in names}
                yield from put({c: part(a, at, edge) for c, a in whole.items()})
            held, at = [], edge
        held.append(batch.slice(at))
    if held:
        yield from put(held_columns(held))
    yield from given()
