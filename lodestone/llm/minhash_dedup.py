"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on full shingle sets.

1. One pass gives each document the number of its distinct word shingles, a 128-bit
   key of the set, ``BANDS`` band keys of ``ROWS`` MinHash samples, and an odd sketch:
   all samples folded into ``BITS`` parity bits, so that the XOR of two sketches counts
   the samples that differ.
2. Equal sets become one class, stood for by its smallest id.
3. In each band bucket every member is paired with one hub (another one by bucket).
   The XOR population count drops unlikely pairs and picks each member's best hub,
   and that pair is confirmed on the full sets: links grow with members, not pairs.
4. Components of those links are taken.  Where a bucket still meets several
   components, all its pairs across components are compared by sketch, in blocks of
   bounded size.  Members with a partner within reach of the threshold get their full
   sets sent to that block, which confirms there and returns the links that join
   components, at most one a member.  So no bucket is capped, no pairs are written, and
   no link between components is lost; pairs inside a component need no check.
5. Components of all confirmed links give each document its group.

Hubs' and copies' rows go through joins of written tables, whose skewed keys the
planner can split; nothing by document reaches the driver.

Defined results: null and empty texts, and texts of white space, have no shingles and
link with nothing; texts with fewer words than the shingle have one shingle, the whole
sequence; rows that share an id are one document, with equal rows in the result; null
ids link with nothing and are kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_broadcast, connected_components, cut, map_groups, mix64, scratch, shingle_hashes, small_batches, text_chunks, texts_of, word_hashes

BANDS, ROWS, BITS = 24, 5, 512
#: Members of a bucket that one comparison block holds, and ids that are broadcast at most.
BLOCK, FEW_IDS = 512, 1_000_000

_SEED = np.random.default_rng(20260101)
_A = (_SEED.integers(0, 1 << 31, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_B = _SEED.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)


def distinct_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and where each text's start."""
    words, starts = word_hashes(texts, lower=True)
    hashes, first = shingle_hashes(words, starts, width)
    own = np.repeat(np.arange(len(texts)), np.diff(first))
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        hashes[lo:hi].sort()
    new = np.ones(len(hashes), bool)
    if len(hashes):
        new[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=len(texts)))]).astype(np.int64)


def signatures(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit set keys, band keys and odd sketches (as 64-bit words) of the non-empty sets."""
    starts = first[:-1]
    with np.errstate(over="ignore"):
        mixed = mix64(sets)
        keys = np.stack([np.add.reduceat(mixed, starts), np.bitwise_xor.reduceat(mix64(mixed ^ np.uint64(0x5BD1E995)), starts)], 1)
        low = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        samples = np.stack([np.minimum.reduceat(low * a + b, starts) for a, b in zip(_A, _B, strict=True)], 1)
        bands = np.zeros((len(starts), BANDS), np.uint64)
        for r in range(ROWS):
            bands = mix64(bands * np.uint64(31) + samples[:, r::ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B1))
        place = mix64(samples.astype(np.uint64) + (np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
        flat = (np.arange(len(starts), dtype=np.int64)[:, None] * BITS + place.astype(np.int64)).ravel()
        odd = np.packbits((np.bincount(flat, minlength=len(starts) * BITS) & 1).astype(np.uint8)).reshape(len(starts), BITS // 8)
    return keys, bands, odd.view(np.uint64)


def reach(percent: int, deviations: float = 4.5) -> int:
    """The largest XOR population count that a pair at the threshold may well have."""
    k, t = BANDS * ROWS, percent / 100
    differ = k * (1 - t) + deviations * np.sqrt(k * t * (1 - t))
    return int(np.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * differ)) + 6))


def _lists(values: np.ndarray) -> pa.ListArray:
    n, w = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, k1, k2, bands and odd of each row; without shingles the last four are 0 and empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            sets, first = distinct_sets(texts_of(batch, "text"), width)
            n = np.diff(first)
            some = n > 0
            keys, bands, odd = signatures(sets, np.concatenate([first[:-1][some], first[-1:]])) if some.any() else (np.zeros((0, 2), np.uint64), np.zeros((0, BANDS), np.uint64), np.zeros((0, BITS // 64), np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").filter(pa.array(some)), pa.array(n[some].astype(np.int64)), pa.array(keys[:, 0].copy().view(np.int64)), pa.array(keys[:, 1].copy().view(np.int64)), _lists(bands), _lists(odd)],
                ["doc_id", "n", "k1", "k2", "bands", "odd"],
            )
            if not some.all():
                none = int((~some).sum())
                zero, empty = pa.array(np.zeros(none, np.int64)), pa.array([[]] * none, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(~some)), zero, zero, zero, empty, empty], ["doc_id", "n", "k1", "k2", "bands", "odd"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>, odd array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles): the sorted distinct shingle hashes of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            sets, first = distinct_sets(texts_of(batch, "text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64)))], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have the similarity."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = cut(full_sets(docs.join(bounded_broadcast(ids, FEW_IDS), "doc_id", "left_semi"), width).dropDuplicates(["doc_id"]))
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb") - common).alias("u")).filter(f"100 * i >= {percent} * u").select("a", "b")


def dealt(members: DataFrame) -> DataFrame:
    """Buckets' members in pairs of blocks (i, j): groups of bounded size that hold each pair across components once.

    The members of a bucket's largest component meet only those outside of it, so rows grow
    with members where one component has most of a bucket.
    """
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    major = cut(counts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("size")).select("key", F.col("m.comp").alias("major"), F.ceil((F.col("size") - F.col("m.n")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("m.n") / BLOCK).cast("int").alias("many")))
    inside = F.col("comp") == F.col("major")
    hashed = F.xxhash64("doc_id")
    last = F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    return (
        members.join(major, "key")
        .withColumn("own", F.when(inside, F.col("few") + F.pmod(hashed, F.col("many"))).otherwise(F.pmod(hashed, F.col("few"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "comp", "bands", "odd")
    )


def likely(g: dict, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of the group) across components whose sketches differ in at most ``most`` bits and whose first common band is this bucket."""
    left, right = np.flatnonzero(g["own"] == g["i"][0]), np.flatnonzero(g["own"] == g["j"][0])
    odd, bands = g["odd"][0].view(np.uint64).reshape(-1, BITS // 64), g["bands"][0].reshape(-1, BANDS)
    same = g["i"][0] == g["j"][0]
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(left), 128):
        part = left[lo : lo + 128]
        bits = np.zeros((len(part), len(right)), np.uint16)
        for w in range(BITS // 64):
            bits += np.bitwise_count(odd[part, w][:, None] ^ odd[right, w][None, :])
        x, y = np.nonzero((bits <= most) & (g["comp"][part][:, None] != g["comp"][right][None, :]))
        x, y = part[x], right[y]
        if same:
            x, y = x[x < y], y[x < y]
        for c in range(0, len(x), 65536):
            u, v = x[c : c + 65536], y[c : c + 65536]
            first = (bands[u] == bands[v]).argmax(1)
            mine = bands[u, first] == g["key"][0]
            xs.append(u[mine])
            ys.append(v[mine])
    return np.concatenate(xs), np.concatenate(ys)


def flagged(members: DataFrame, most: int) -> DataFrame:
    """(key, i, j, own, doc_id) of the members that have a likely pair in a group: rows grow with members, not with pairs."""

    def run(g: dict) -> list | None:
        x, y = likely(g, most)
        at = np.unique(np.concatenate([x, y]))
        return [pa.array(g[c][at]) for c in ("key", "i", "j", "own", "doc_id")] if len(at) else None

    return map_groups(dealt(members), ["key", "i", "j"], run, "key long, i int, j int, own int, doc_id long")


def confirmed(g: dict, most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (ids) that join components of a group, confirmed on its members' full sets.

    Intersections come from the group's own inverted lists; pairs that earlier links have
    joined already need no check.
    """
    x, y = likely(g, most)
    values, first = g["shingles"]
    size = np.diff(first)
    _, ids = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(ids, kind="stable")
    posted = owner[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(ids))]).astype(np.int64)
    roots = {c: c for c in g["comp"].tolist()}

    def root(c: int) -> int:
        while roots[c] != c:
            roots[c] = roots[roots[c]]
            c = roots[c]
        return c

    a, b = [], []
    by = np.argsort(x, kind="stable")
    x, y = x[by], y[by]
    cuts = np.flatnonzero(np.diff(x)) + 1
    comp = g["comp"]
    for lo, hi in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(x)]]).tolist(), strict=True) if len(x) else []:
        u, others = int(x[lo]), y[lo:hi]
        mine = root(int(comp[u]))
        others = others[[root(int(c)) != mine for c in comp[others]]]
        if not len(others):
            continue
        own = ids[first[u] : first[u + 1]]
        n = start[own + 1] - start[own]
        lists = posted[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[own], n)]
        common = np.bincount(lists, minlength=len(size))[others]
        for v in others[100 * common >= percent * (size[u] + size[others] - common)].tolist():
            r, q = root(int(comp[u])), root(int(comp[v]))
            if r != q:
                roots[max(r, q)] = min(r, q)
                a.append(g["doc_id"][u])
                b.append(g["doc_id"][v])
    return np.array(a, np.int64), np.array(b, np.int64)


def across(texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between different components that meet in a bucket.

    ``members``: key, doc_id, comp, bands, odd.  Large buckets are cut into blocks, and each
    pair of blocks is one group of bounded size.  A first pass over
    sketches finds who has a likely partner where; only their sets are sent there.
    """
    most = reach(percent)
    marks = cut(flagged(members, most))
    ids = cut(marks.select("doc_id").distinct())
    sets = cut(full_sets(texts.join(bounded_broadcast(ids, FEW_IDS), "doc_id", "left_semi"), width).dropDuplicates(["doc_id"]))
    facts = cut(members.select("doc_id", "comp", "bands", "odd").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).join(sets, "doc_id"))
    rows = marks.join(facts, "doc_id").select("key", "i", "j", "own", "doc_id", "comp", "bands", "odd", "shingles")

    def run(g: dict) -> list | None:
        a, b = confirmed(g, most, percent)
        return [pa.array(a), pa.array(b)] if len(a) else None

    return map_groups(rows, ["key", "i", "j"], run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Two documents link where 100 * intersection >= ``percent`` * union of their sets of
    ``width``-word shingles.
    """
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as steps:
        return steps.keep(_near_duplicates(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")), width, percent))


def _near_duplicates(texts: DataFrame, width: int, percent: int) -> DataFrame:
    rows = cut(sketch(texts, width))
    known = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = cut(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = cut(known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "bands", "odd")).alias("m")).select("doc_id", "m.bands", "m.odd"))

    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = cut(banded.groupBy("key").agg(F.min(F.expr("doc_id ^ key")).alias("code"), F.count("*").alias("size")).filter("size > 1").select("key", F.expr("code ^ key").alias("hub"), "size"))
    members = cut(banded.join(buckets, "key"))
    most = reach(percent)
    odd = reps.select("doc_id", "odd")
    hubs = members.filter("doc_id != hub").select("doc_id", "hub").distinct()
    near = (
        hubs.join(odd, "doc_id")
        .join(odd.select(F.col("doc_id").alias("hub"), F.col("odd").alias("hub_odd")), "hub")
        .withColumn("bits", F.aggregate(F.zip_with("odd", "hub_odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x))
        .filter(F.col("bits") <= most)
    )
    best = cut(near.groupBy("doc_id").agg(F.min(F.struct("bits", "hub")).alias("best")).select(F.col("doc_id").alias("a"), F.col("best.hub").alias("b")))
    links = cut(confirm(texts, best, width, percent))
    first = cut(connected_components(links))

    # what is left: pairs across components in one bucket
    placed = members.select("key", "doc_id").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    placed = cut(placed)
    open_ = cut(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key"))
    more = across(texts, cut(placed.join(open_, "key").join(reps, "doc_id")), width, percent)
    groups = cut(connected_components(links.unionByName(more)))

    named = rows.select("doc_id", "n", "k1", "k2").join(classes.filter("copies > 1").select("k1", "k2", "rep"), ["k1", "k2"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    named = named.select("doc_id", "n", own.alias("node"))
    component = F.coalesce("component", "node")
    return named.join(groups, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
