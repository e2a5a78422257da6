"""Near-duplicate passages by compact windows.

1. Equal texts become one class; every copy but the first is one passage as a whole.
2. Tokens are shingles of ``WIDTH`` words.  For each of ``HASHES`` hash functions all
   subsequences of at least ``least`` words whose minimum lies at the same token form
   one compact window (left, centre, right): the Cartesian tree over the hashes, of
   which only the nodes wide enough are kept.  A sliding minimum finds those nodes, and
   a stack over them alone their bounds, so a text of n tokens gives about
   2 n / least windows a function.
3. Windows that share a minimum meet in one group.  Each is linked to the group's first
   text and to the one before it, so a group's links grow with its members.
4. Of each pair of texts, windows that overlap are joined into regions; a region that
   ``AGREE`` functions share is verified: shared shingles are chained into passages, and
   a passage counts where the Jaccard similarity of both sides' shingle sets is at
   least ``percent`` hundredths.
5. Groups of more than three windows hold pairs that were not linked.  A window there is
   open while its context, the shingles that a shortest passage around its centre can
   reach, is not covered by passages found.  Windows of equal contexts are stood for by
   their first text.  What two others share holds a shingle that is rare in the group, and
   then one near to their centres, or frequent ones alone that reach over a passage's
   length.  Groups over ``BLOCK`` go to pairs of blocks; those over ``SPLIT`` blocks are
   split into groups by a rare shingle, which are bounded, and the distinct profiles of
   frequent shingles, which go to pairs of blocks too.  Inside a group the same rule names
   the partners of smaller ids, which are verified on the contexts.  A window keeps the partners that cover more of it, so links don't grow
   with pairs; they go through step 4 with one function being enough.

Passages of a text are reported against smaller ids only, so the first text that has a
passage keeps it.  Not all texts that share a passage are named; its parts are meant to be
reported against one of them at least, which holds for passages without edits and for
nearly all with edits (the README has figures).

Defined results: null, empty and short texts have no passage; repeated equal rows give
one report (ids are expected to be unique: differing rows that share one are compared
each and reported under it); null ids are left out; an empty table gives no rows; other
columns are ignored by ``passages`` and carried by ``remove``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_broadcast, cut, map_groups, mix64, scratch, shingle_hashes, small_batches, text_chunks, texts_of, word_hashes

WIDTH, HASHES, AGREE = 5, 4, 2
#: Words of the shortest passage.
LEAST = 50
#: Windows that a block of a group holds; windows from which a shingle is frequent in a block, and rare ones that a split looks at on either side of a centre.
BLOCK, HOT, RARE = 2048, 32, 16
#: Blocks from which a group is split: all pairs of blocks send a window once a block, the split up to 2 x ``RARE`` times.
SPLIT = 8
#: Shingles that a chain may jump over, and ids that are broadcast at most.
GAP, FEW_IDS = 15, 1_000_000

SEEDS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def compact_windows(values: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, left, centre, right) of each compact window of at least ``least`` tokens; bounds are positions in the text.

    ``values``: hashes of all texts' tokens in a row; ``first``: where each text's start.
    Of equal minima the leftmost is the centre.
    """
    none = np.zeros(0, np.int64)
    n = np.diff(first)
    fit = np.flatnonzero(n >= least)
    if not len(fit):
        return none, none, none, none
    low, span = values, 1
    while 2 * span <= least:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < least:
        low = np.minimum(low[: len(values) - least + 1], low[least - span : len(values) - span + 1])
    count = n[fit] - least + 1
    text = np.repeat(fit, count)
    begin = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[fit], count)
    v = low[begin]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (text[1:] != text[:-1])])
    run = np.flatnonzero(new)
    last = np.concatenate([run[1:], [len(v)]]) - 1
    text, start, end, v = text[run], begin[run], begin[last], v[run]
    centre = np.empty(len(run), np.int64)
    for lo in range(0, len(run), 65536):
        s = start[lo : lo + 65536]
        centre[lo : lo + 65536] = s + (values[s[:, None] + np.arange(least)] == v[lo : lo + 65536, None]).argmax(1)
    # the tree's bounds: the nearest smaller centre on either side
    before, after = np.full(len(run), -1, np.int64), np.full(len(run), -1, np.int64)
    stack: list[int] = []
    own, vs, prev = text.tolist(), v.tolist(), -1
    for k in range(len(own)):
        if own[k] != prev:
            stack, prev = [], own[k]
        while stack and vs[stack[-1]] > vs[k]:
            after[stack.pop()] = k
        if stack:
            before[k] = stack[-1]
        stack.append(k)
    edge = centre - least + 1
    left = np.where(start > edge, start, np.where(before >= 0, centre[before] + 1, first[text]))
    right = np.where(end < centre, end + least - 1, np.where(after >= 0, centre[after] - 1, first[text + 1] - 1))
    base = first[text]
    return text, left - base, centre - base, right - base


def _shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, starts = word_hashes(texts)
    return shingle_hashes(words, starts, WIDTH, short=False)


WINDOW_SCHEMA = "key long, doc_id long, at long, ext long"


def windows(docs: DataFrame, least: int) -> DataFrame:
    """Compact windows of each text: key, doc_id, at = centre << 8 | function, ext = shingles left of it << 32 | right of it."""
    tokens = least - WIDTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            hashes, first = _shingles(texts_of(batch, "text"))
            parts = []
            for f, seed in enumerate(SEEDS):
                values = mix64(hashes ^ seed)
                text, left, centre, right = compact_windows(values, first, tokens)
                parts.append((values[first[text] + centre].view(np.int64), ids[text], centre << 8 | f, (centre - left) << 32 | (right - centre)))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in WINDOW_SCHEMA.split(", ")])

    return docs.mapInArrow(run, WINDOW_SCHEMA)


SIDE = "named_struct('src', doc_id, 'src_at', at, 'src_ext', ext)"


def met(found: DataFrame) -> DataFrame:
    """The windows that share their key, with the first of its group, the one before and the group's size."""
    group = Window.partitionBy("key")
    by = group.orderBy("doc_id", "at")
    return found.withColumn("hub", F.first(F.expr(SIDE)).over(by)).withColumn("prev", F.lag(F.expr(SIDE)).over(by)).withColumn("size", F.count("*").over(group)).filter("size > 1")


def near_links(near: DataFrame) -> DataFrame:
    """(doc_id, at, ext, s) of each window with the first of its group and the one before."""
    links = F.filter(F.array_distinct(F.array("hub", "prev")), lambda s: s["src"].isNotNull() & (s["src"] != F.col("doc_id")))
    return near.select("doc_id", "at", "ext", F.explode(links).alias("s"))


def regions(links: DataFrame, agree: int = AGREE) -> DataFrame:
    """doc_id, src, lo, hi, src_lo, src_hi: regions of two texts where linked windows of ``agree`` functions overlap."""
    bounds = lambda at, ext: (F.expr(f"shiftright({at}, 8) - shiftright({ext}, 32)"), F.expr(f"shiftright({at}, 8) + ({ext} & 4294967295)"))
    (left, right), (src_left, src_right) = bounds("at", "ext"), bounds("s.src_at", "s.src_ext")
    pairs = links.select("doc_id", F.col("s.src").alias("src"), left.alias("l"), right.alias("r"), src_left.alias("sl"), src_right.alias("sr"), F.expr("shiftleft(1, cast(at & 255 AS int))").alias("f"))
    # overlapping intervals of a pair, in order of their left ends, are one region
    order = Window.partitionBy("doc_id", "src").orderBy("l", "r", "sl")
    reached = F.max("r").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cuts = pairs.withColumn("new", F.coalesce((F.col("l") > reached).cast("int"), F.lit(0))).withColumn("region", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = cuts.groupBy("doc_id", "src", "region").agg(F.min("l").alias("lo"), F.max("r").alias("hi"), F.min("sl").alias("src_lo"), F.max("sr").alias("src_hi"), F.bit_or("f").alias("functions"))
    return joined.filter(F.bit_count("functions") >= agree).drop("region", "functions")


CONTEXT_SCHEMA = "key long, doc_id long, at long, ext long, same long, open boolean, mid int, context array<int>"


def contexts(docs: DataFrame, near: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """Of the windows in groups of over three: the shingles around the centre, and a hash of them all (same).

    context: 31 bits of each shingle's hash and, lowest, whether no passage of ``found``
    covers it (bare); mid: the centre's place; open: whether any is bare.
    """
    tokens = least - WIDTH + 1
    wanted = near.filter("size > 3").groupBy("doc_id").agg(F.collect_list(F.struct("key", "at", "ext")).alias("w"))  # a text's own windows
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n_words")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            hashes, first = _shingles(texts_of(batch, "text"))
            bare = np.ones(len(hashes), np.int64)
            for d, covered in enumerate(batch.column("spans").to_pylist()):
                for p in covered or []:
                    bare[first[d] + p["start"] : min(first[d] + p["start"] + p["n_words"] - WIDTH + 1, first[d + 1])] = 0
            w = batch.column("w").flatten()
            key, at, ext = (w.field(c).to_numpy(zero_copy_only=False) for c in ("key", "at", "ext"))
            d = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False))
            # of rows that share an id, each knows its own windows by their minima
            mine = first[d] + (at >> 8) + (ext & 0xFFFFFFFF) < first[d + 1]
            mine[mine] = mix64(hashes[first[d[mine]] + (at[mine] >> 8)] ^ SEEDS[at[mine] & 255]).view(np.int64) == key[mine]
            key, at, ext, d = key[mine], at[mine], ext[mine], d[mine]
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[d]
            centre = first[d] + (at >> 8)
            lo, hi = centre - np.minimum(ext >> 32, tokens - 1), centre + np.minimum(ext & 0xFFFFFFFF, tokens - 1) + 1
            # prefix sums of hashes, plain and by place, tell equal stretches
            mixed, place = mix64(hashes), np.arange(len(hashes), dtype=np.uint64)
            with np.errstate(over="ignore"):
                sums, placed = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (mixed, mixed * place))
                total = sums[hi] - sums[lo]
                same = mix64(total ^ mix64(placed[hi] - placed[lo] - lo.astype(np.uint64) * total + (hi - lo).astype(np.uint64))).view(np.int64)
            bares = np.concatenate([[0], np.cumsum(bare)])
            small = ((hashes >> np.uint64(33)).astype(np.int64) << 1 | bare).astype(np.uint32).view(np.int32)
            for k in range(0, len(key), 16384):
                part = slice(k, k + 16384)
                n = hi[part] - lo[part]
                ends = np.cumsum(n)
                values = small[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(lo[part], n)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
                columns = [key[part], doc[part], at[part], ext[part], same[part], bares[hi[part]] > bares[lo[part]], (centre - lo)[part].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], [f.split()[0] for f in CONTEXT_SCHEMA.split(", ")])

    return docs.join(wanted, "doc_id").join(spans, "doc_id", "left").select("doc_id", "text", "w", "spans").mapInArrow(run, CONTEXT_SCHEMA)


def beside(rare: np.ndarray, first: np.ndarray, mid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a row) of the ``RARE`` rare shingles of each context that are nearest to its centre on either side, and their sides."""
    row = np.repeat(np.arange(len(mid)), np.diff(first))
    upto = np.concatenate([[0], np.cumsum(rare)])
    centre = first[:-1] + mid
    at = np.flatnonzero(rare)
    left = at < centre[row[at]]
    between = np.where(left, upto[centre[row[at]]] - upto[at] - 1, upto[at] - upto[np.minimum(centre[row[at]] + 1, len(rare))])
    ok = (between >= 0) & (between < RARE) & (at != centre[row[at]])
    return at[ok], left[ok].astype(np.int64)


def candidates(ids: np.ndarray, counts: np.ndarray, first: np.ndarray, g: dict, bare: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (window, possible partner of a smaller id) of a group.

    What two windows share of a passage holds the common centre and reaches ``tokens``
    shingles.  Either a shingle that is rare in the group is among it, on the same side of
    the centre, or it is all of frequent ones.
    """
    n, doc, own = len(first) - 1, g["doc_id"], g["own"]
    row = np.repeat(np.arange(n), np.diff(first))
    frequent = counts[ids] > HOT
    centre = (first[:-1] + g["mid"])[row]
    at = np.flatnonzero(~frequent & (counts[ids] > 1) & (np.arange(len(ids)) != centre))
    side = (at < centre[at]).astype(np.int64)
    code = ids[at] * 2 + side
    by = np.argsort(code, kind="stable")
    code, who = code[by], row[at][by]
    pairs = [np.zeros(0, np.int64)]
    for step in range(1, HOT):
        same = np.flatnonzero(code[step:] == code[:-step])
        if not len(same):
            break
        u, v = who[same], who[same + step]
        u, v = np.where(doc[u] > doc[v], u, v), np.where(doc[u] > doc[v], v, u)
        ok = (doc[u] > doc[v]) & g["open"][u]
        codes = u[ok] * n + v[ok]
        pairs.append(np.unique(codes) if len(codes) > 4096 else codes)
    # frequent shingles that reach over a passage's length
    place = np.flatnonzero(frequent)
    low, high = np.full(n, len(ids)), np.full(n, -1)
    np.minimum.at(low, row[place], place)
    np.maximum.at(high, row[place], place)
    wide = high - low >= tokens - 1
    hungry = np.zeros(n, bool)
    hungry[row[place[bare[place]]]] = True
    others = np.flatnonzero(wide)
    for u in np.flatnonzero(wide & hungry & g["open"]).tolist():
        pairs.append(u * n + others[doc[others] < doc[u]])
    codes = np.unique(np.concatenate(pairs))
    u, v = codes // n, codes % n
    if g["i"][0] != g["j"][0]:
        u, v = u[own[u] != own[v]], v[own[u] != own[v]]
    return u, v


@functools.cache
def spans_of(n: int, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each span of at least ``tokens`` in a sequence of ``n``."""
    i, j = np.triu_indices(n, tokens - 1)
    return i, j


def may_hold(shared: np.ndarray, at: np.ndarray, left: np.ndarray, tokens: int, percent: int) -> np.ndarray:
    """Of each partner, whether some span that both ends of are shared is similar enough and holds a shingle of ``left``.

    shared: partner x place; at: the partner's place of a shared shingle.  For sequences without repeated shingles.
    """
    i, j = spans_of(shared.shape[1], tokens)
    out = np.zeros(len(shared), bool)
    if not len(i):
        return out
    zero = np.zeros((len(shared), 1), np.int16)
    sums, useful = (np.concatenate([zero, np.cumsum(x, 1, dtype=np.int16)], 1) for x in (shared, shared & left))
    at = at.astype(np.int16)
    x = (j - i + 1).astype(np.int16)
    for lo in range(0, len(shared), 256):
        part = slice(lo, lo + 256)
        same = sums[part][:, j + 1] - sums[part][:, i]
        y = np.abs(at[part][:, j] - at[part][:, i]) + 1
        ok = (100 * same.astype(np.int32) >= percent * (x + np.maximum(y, same) - same)) & shared[part][:, i] & shared[part][:, j]
        out[part] = (ok & (useful[part][:, j + 1] > useful[part][:, i])).any(1)
    return out


def partners(g: dict, tokens: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, partner) rows of a group: the partners of smaller ids, verified on the contexts, that cover a window's bare shingles."""
    packed, first = g["context"]
    values, bare = packed >> 1 & 0x7FFFFFFF, (packed & 1).astype(bool)
    doc, n = g["doc_id"], len(g["doc_id"])
    distinct, ids, counts = np.unique(values, return_inverse=True, return_counts=True)
    place = np.full(len(distinct), -1)
    by_row = np.sort(np.repeat(np.arange(n), np.diff(first)) * len(distinct) + ids)
    repeated = np.zeros(n, bool)
    repeated[by_row[1:][by_row[1:] == by_row[:-1]] // max(len(distinct), 1)] = True

    a, b = [], []
    us, vs = candidates(ids, counts, first, g, bare, tokens)
    cuts = np.flatnonzero(np.diff(us)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(us)], strict=True) if len(us) else []:
        u, all_ = int(us[lo]), vs[lo:hi]
        mine, left = ids[first[u] : first[u + 1]], bare[first[u] : first[u + 1]].copy()
        uniq, back = np.unique(mine, return_inverse=True) if repeated[u] else (mine, slice(None))
        place[uniq] = np.arange(len(uniq))
        kept = []
        for k in range(0, len(all_), 4096):
            some = all_[k : k + 4096]
            m = first[some + 1] - first[some]
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            at = place[ids[inner + np.repeat(first[some], m)]]
            where = np.full((len(some), len(uniq)), -1, np.int16)
            where[np.repeat(np.arange(len(some)), m)[at >= 0], at[at >= 0]] = inner[at >= 0]
            where = where[:, back]
            shared = where >= 0
            ok = (len(mine) - shared[:, ::-1].argmax(1) - shared.argmax(1) >= tokens) & (shared & left).any(1)
            kept.append((some[ok], where[ok]))
        place[uniq] = -1
        some, where = (np.concatenate(c) for c in zip(*kept, strict=True))
        order = np.argsort(doc[some], kind="stable")
        some, where = some[order], where[order]
        unclear = repeated[some] | repeated[u]
        ok = unclear | (100 * (where >= 0).sum(1) >= percent * tokens)  # as much as any span needs that may hold
        some, where, unclear = some[ok], where[ok], unclear[ok]
        while len(some):
            ok = unclear | may_hold(where >= 0, where, left, tokens, percent)
            some, where, unclear = some[ok], where[ok], unclear[ok]
            gain = ((where >= 0) & left).sum(1)
            while len(some) and gain.any():
                v = int(gain.argmax())
                gain[v] = 0
                x = int(some[v])
                before = left.sum()
                for s, m, *_ in chains(values[first[u] : first[u + 1]], values[first[x] : first[x + 1]], tokens, percent):
                    left[s : s + m] = False
                if left.sum() < before:
                    a.append(u)
                    b.append(x)
                    break
            else:
                break
            rest = gain > 0
            some, where, unclear = some[rest], where[rest], unclear[rest]
    return np.array(a, np.int64), np.array(b, np.int64)


def equal_ones(g: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a group: windows with the first one of equal context (rows, rows), and which rows stand for their context."""
    order = np.lexsort((g["at"], g["doc_id"], g["same"]))
    same = g["same"][order]
    start = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[start], np.diff(np.concatenate([start, [len(order)]])))
    stands = g["doc_id"] == g["doc_id"][first]
    rows = np.flatnonzero(~stands & g["open"])
    return rows, first[rows], np.flatnonzero(stands)


def taken(g: dict, rows: np.ndarray) -> dict:
    """Those rows of a group."""
    values, first = g["context"]
    n = first[rows + 1] - first[rows]
    ends = np.cumsum(n)
    at = np.arange(n.sum()) - np.repeat(ends - n, n) + np.repeat(first[rows], n)
    return {c: v[rows] for c, v in g.items() if c != "context"} | {"context": (values[at], np.concatenate([[0], ends]))}


DEALT = ["key", "i", "j", "own", "doc_id", "at", "ext", "same", "open", "mid", "context"]


def in_blocks(rows: DataFrame) -> DataFrame:
    """Groups with an open window in pairs of blocks (i, j) of at most ``BLOCK`` windows each, about."""
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("any")).filter("n > 1 AND any").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    return spread(rows.join(sizes, "key"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows that know their group's blocks, once for each pair of blocks that theirs is in."""
    return (
        rows.withColumn("own", F.pmod(F.xxhash64("doc_id", "at"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *DEALT[3:])
    )


def by_context(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of windows to the first one of equal context in their group, and those first ones."""
    firsts = cut(rows.groupBy("key", "same").agg(F.min(F.struct(F.col("doc_id").alias("src"), F.col("at").alias("src_at"), F.col("ext").alias("src_ext"))).alias("s"), F.count("*").alias("n")))
    equal = rows.filter("open").join(firsts.filter("n > 1").drop("n"), ["key", "same"]).filter("s.src != doc_id").select("doc_id", "at", "ext", "s")
    return equal, rows.join(firsts.select("key", "same", F.col("s.src").alias("doc_id")), ["key", "same", "doc_id"], "left_semi")


def split(large: DataFrame, tokens: int) -> tuple[DataFrame, DataFrame]:
    """Windows of groups over ``SPLIT`` blocks: those that share a rare shingle near their centres, dealt as groups of their own, and those with frequent ones over a passage's length.

    A group is looked at in parts of about ``BLOCK`` windows.  Frequent is what over
    ``BLOCK`` / parts windows of a part hold, so a rare shingle stands in ``BLOCK`` windows
    about.  What is shared by frequent shingles alone is decided among the distinct
    profiles of them.  Groups by rare shingles that have the same windows are one.
    """
    sizes = cut(large.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    parted = large.join(sizes, "key").select("key", F.pmod(F.xxhash64("at", "doc_id"), F.col("parts")).cast("int").alias("part"), "parts", "context")

    def frequent_of(g: dict) -> list | None:
        packed, first = g["context"]
        pair = np.unique(np.repeat(np.arange(len(first) - 1), np.diff(first)) << 31 | packed.astype(np.int64) >> 1 & 0x7FFFFFFF)
        values, counts = np.unique(pair & 0x7FFFFFFF, return_counts=True)
        values = values[counts > max(BLOCK // int(g["parts"][0]), 1)]
        return [pa.array(np.full(len(values), g["key"][0])), pa.array(values.astype(np.int32))] if len(values) else None

    frequent = map_groups(parted, ["key", "part"], frequent_of, "key long, h int")
    told = cut(large.join(frequent.groupBy("key").agg(F.collect_set("h").alias("frequent")), "key", "left"))  # a group's frequent shingles: some of each part

    def masks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = batch.column("context")
        packed = lists.flatten().to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        key = np.repeat(batch.column("key").to_numpy(zero_copy_only=False), np.diff(first))
        hot = np.zeros(len(packed), bool)
        for k, r in zip(*np.unique(batch.column("key").to_numpy(zero_copy_only=False), return_index=True), strict=True):
            mine = np.flatnonzero(key == k)
            hot[mine] = np.isin(packed[mine] >> 1 & 0x7FFFFFFF, batch.column("frequent")[int(r)].as_py() or [])
        return packed, first, hot

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed, first, hot = masks(batch)
                at, side = beside(~hot, first, batch.column("mid").to_numpy(zero_copy_only=False))
                row = np.repeat(np.arange(batch.num_rows), np.diff(first))[at]
                key = batch.column("key").to_numpy(zero_copy_only=False)[row]
                sub = mix64(key.view(np.uint64) ^ mix64((packed[at] >> 1 & 0x7FFFFFFF).astype(np.uint64) * np.uint64(2) + side.astype(np.uint64))).view(np.int64)
                _, once = np.unique(np.stack([sub, row]), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(sub[once]), *(batch.column(c).take(pa.array(row[once])) for c in ("key", "doc_id", "at", "open"))], ["sub", "key", "doc_id", "at", "open"])

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed, first, hot = masks(batch)
                row, at = np.repeat(np.arange(batch.num_rows), np.diff(first)), np.arange(len(packed))
                low, high, open_ = np.full(batch.num_rows, len(packed)), np.full(batch.num_rows, -1), np.zeros(batch.num_rows, bool)
                np.minimum.at(low, row[hot], at[hot])
                np.maximum.at(high, row[hot], at[hot])
                open_[row[hot & (packed & 1 == 1)]] = True
                with np.errstate(over="ignore"):
                    terms = np.where(hot, mix64((packed >> 1).astype(np.uint64)) * mix64((at - np.minimum(low[row], at)).astype(np.uint64) + np.uint64(1)), np.uint64(0))
                    same = np.add.reduceat(terms, first[:-1])  # a context is never empty
                keep = pa.array(high - low >= tokens - 1)
                made = batch.select([f.split()[0] for f in CONTEXT_SCHEMA.split(", ")])
                made = made.set_column(4, "same", pa.array(same.view(np.int64))).set_column(5, "open", pa.array(open_))
                yield made.filter(keep)

    marks = cut(told.mapInArrow(rare, "sub long, key long, doc_id long, at long, open boolean"))
    several = marks.groupBy("sub").agg(F.count("*").alias("n"), F.max("open").alias("any"), F.sum(F.xxhash64("key", "doc_id", "at").cast("decimal(38,0)")).alias("who")).filter("n > 1 AND any")
    several = several.groupBy("n", "who").agg(F.min("sub").alias("sub")).select("sub", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    near = marks.join(several, "sub").drop("open").join(large, ["key", "doc_id", "at"]).drop("key").withColumnRenamed("sub", "key")
    return spread(near), told.mapInArrow(profiles, CONTEXT_SCHEMA)


def open_links(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """(doc_id, at, ext, s) of open windows with partners of smaller ids in their groups; ``rows``: as ``contexts`` gives them."""
    tokens = least - WIDTH + 1
    rows = cut(rows)
    big = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("any")).filter(f"n > {BLOCK} AND any").select("key"))
    links = []
    if big.isEmpty():
        dealt = in_blocks(rows)
    else:
        equal, reps = by_context(cut(rows.join(big, "key", "left_semi")))
        links, reps = [equal], cut(reps)
        huge = cut(reps.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT * BLOCK).select("key"))
        dealt = in_blocks(rows.join(big, "key", "left_anti").unionByName(reps.join(huge, "key", "left_anti").select(*rows.columns)))
        if not huge.isEmpty():
            near, profiles = split(cut(reps.join(huge, "key", "left_semi")), tokens)
            more, first = by_context(cut(profiles))
            links.append(more)
            dealt = dealt.unionByName(near).unionByName(in_blocks(cut(first)))

    def run(g: dict) -> list | None:
        u, v, stand = equal_ones(g)
        if g["i"][0] != g["j"][0]:
            u, v, stand = u[:0], v[:0], np.arange(len(g["own"]))
        a, b = partners(taken(g, stand), tokens, percent)
        a, b = np.concatenate([u, stand[a]]), np.concatenate([v, stand[b]])
        return [*(pa.array(g[c][a]) for c in ("doc_id", "at", "ext")), *(pa.array(g[c][b]) for c in ("doc_id", "at", "ext"))] if len(a) else None

    found = map_groups(dealt, ["key", "i", "j"], run, "doc_id long, at long, ext long, src long, src_at long, src_ext long").select("doc_id", "at", "ext", F.struct("src", "src_at", "src_ext").alias("s"))
    for more in links:
        found = found.unionByName(more)
    return found


def chains(a: np.ndarray, b: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """(start, shingles, start in b, shingles there, similarity) of the passages that two shingle sequences share."""
    if not len(a) or not len(b):
        return []
    by = np.argsort(b, kind="stable")
    sb = b[by]
    lo, hi = np.searchsorted(sb, a, "left"), np.searchsorted(sb, a, "right")
    hit = np.flatnonzero(hi > lo)
    # without repeated shingles, what holds has at least ``percent`` hundredths of ``least`` and of its length in common
    ordered = np.sort(a)
    enough = percent if (ordered[1:] != ordered[:-1]).all() else 0
    if not len(hit) or 100 * len(hit) < enough * least:
        return []
    # of several places in b: the one that follows the match before, else the one nearest to the diagonal of unique matches
    unique = hit[hi[hit] - lo[hit] == 1]
    place = by[lo[hit]].astype(np.int64)
    anchor = np.clip(np.searchsorted(unique, hit), 0, max(len(unique) - 1, 0))
    expected = by[lo[unique[anchor]]] - unique[anchor] + hit if len(unique) else place
    several = np.flatnonzero(hi[hit] - lo[hit] > 1).tolist()
    if several:
        at, to = hit.tolist(), place.tolist()
        for k in several:
            follow = to[k - 1] + at[k] - at[k - 1] if k else -1
            if 0 <= follow < len(b) and b[follow] == a[at[k]]:
                to[k] = follow
            else:
                options = by[lo[at[k]] : hi[at[k]]]
                to[k] = int(options[np.abs(options - expected[k]).argmin()])
        place = np.array(to, np.int64)
    out = []

    def test(i: int, j: int) -> None:
        if hit[j] - hit[i] + 1 < least or 100 * (j - i + 1) < enough * least:
            return
        own = place[i : j + 1]
        if hit[j] - hit[i] == j - i and (np.diff(own) == 1).all():  # the same shingles in the same order
            out.append((int(hit[i]), j - i + 1, int(own[0]), j - i + 1, 1.0))
            return
        off = own - hit[i : j + 1]
        by_shift = np.sort(off)
        shift = (by_shift[(j - i) // 2] + by_shift[(j - i + 1) // 2]) / 2
        on = np.abs(off - shift) <= max(GAP, (hit[j] - hit[i]) // 5)
        if not on.any():
            return
        if 100 * (j - i + 1) >= enough * (hit[j] - hit[i] + 1):
            b0, b1 = int(own[on].min()), int(own[on].max())
            x, y = np.unique(a[hit[i] : hit[j] + 1]), np.unique(b[b0 : b1 + 1])
            same = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - same
            if 100 * same >= percent * union and b1 - b0 + 1 >= least * percent // 100:
                out.append((int(hit[i]), int(hit[j] - hit[i] + 1), b0, b1 - b0 + 1, same / union))
                return
        step = np.maximum(np.diff(hit[i : j + 1]) - 1, np.minimum(np.abs(np.diff(own) - np.diff(hit[i : j + 1])), 10**6))
        k = int(step.argmax())
        if step[k] > 0:
            todo.append((i, i + k))
            todo.append((i + k + 1, j))

    cutpoints = np.flatnonzero((np.diff(hit) > GAP) | (np.abs(np.diff(place - hit)) > GAP))
    todo = list(zip(np.concatenate([[0], cutpoints + 1]).tolist(), np.concatenate([cutpoints, [len(hit) - 1]]).tolist(), strict=True))
    while todo:
        test(*todo.pop())
    return sorted(out)


PASSAGE_SCHEMA = "doc_id long, start long, n_words long, src_doc_id long, src_start long, src_n_words long, similarity double"


def verify(docs: DataFrame, found: DataFrame, least: int, percent: int) -> DataFrame:
    """Passages of the regions that hold on the texts.

    A region's words travel, not the texts: each text is cut where it lies, and both
    sides of a region meet by its number.
    """
    numbered = cut(found.withColumn("region", F.monotonically_increasing_id()))
    sides = numbered.select("doc_id", "region", F.lit(True).alias("mine"), "lo", "hi").unionByName(numbered.select(F.col("src").alias("doc_id"), "region", F.lit(False).alias("mine"), F.col("src_lo").alias("lo"), F.col("src_hi").alias("hi")))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            texts = texts_of(batch, "text")
            split: dict[bytes, list[bytes]] = {}
            lo, hi = batch.column("lo").to_pylist(), batch.column("hi").to_pylist()
            out = []
            for t, a, b in zip(texts, lo, hi, strict=True):
                if t not in split:
                    split[t] = t.split()
                out.append(b" ".join(split[t][a : b + WIDTH]))
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("mine"), pa.array(out, pa.binary())], ["region", "mine", "words"])

    met = docs.join(bounded_broadcast(sides, FEW_IDS), "doc_id").select("text", "region", "mine", "lo", "hi")
    sliced = met.mapInArrow(slices, "region long, mine boolean, words binary")
    mine, theirs = sliced.filter("mine").select("region", F.col("words").alias("a")), sliced.filter("NOT mine").select("region", F.col("words").alias("b"))
    both = mine.join(theirs, "region").join(numbered, "region")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(text_chunks(batches, "a"), "b"):
            hashes, first = _shingles([*texts_of(batch, "a"), *texts_of(batch, "b")])
            own = lambda k: hashes[first[k] : first[k + 1]]
            rows = []
            for k, (doc, src, lo, src_lo) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "src", "lo", "src_lo")), strict=True)):
                for s, n, t, m, j in chains(own(k), own(batch.num_rows + k), least - WIDTH + 1, percent):
                    rows.append((doc, lo + s, n + WIDTH - 1, src, src_lo + t, m + WIDTH - 1, j))
            if rows:
                types = [pa.int64()] * 6 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in PASSAGE_SCHEMA.split(", ")])

    return both.select("doc_id", "src", "lo", "src_lo", "a", "b").mapInArrow(check, PASSAGE_SCHEMA)


def passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, percent: int = 80) -> DataFrame:
    """A row per passage of at least ``least`` words that a text with a smaller id has too.

    doc_id, start and n_words (in words), src_doc_id, src_start, src_n_words, similarity.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    with scratch(docs.sparkSession) as steps:
        return steps.keep(_passages(texts, least, percent))


def _passages(texts: DataFrame, least: int, percent: int) -> DataFrame:
    words = F.size(F.split(F.col("text"), r"[\x20\x09-\x0D]+"))  # one more at most for white space at either end
    keyed = texts.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), (F.length("text") >= 2 * least - 1).alias("long"))
    classes = keyed.filter("long").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    several = cut(classes.filter("copies > 1"))
    copies = cut(keyed.join(several, ["k1", "k2"]).filter("doc_id != rep").select("doc_id", "rep").distinct())
    if several.isEmpty():
        rest = texts
    else:
        rest = texts.join(bounded_broadcast(copies.select("doc_id"), FEW_IDS), "doc_id", "left_anti")
    with scratch(texts.sparkSession) as step:
        groups = step.keep(met(windows(rest, least)))
    with scratch(texts.sparkSession) as step:
        near = step.keep(verify(rest, cut(regions(near_links(groups))), least, percent))
    with scratch(texts.sparkSession) as step:
        open_ = step.keep(regions(cut(open_links(contexts(rest, groups, near, least), least, percent)), 1))
    near = near.unionByName(verify(rest, open_, least, percent))
    whole = texts.join(bounded_broadcast(copies, FEW_IDS), "doc_id").select("doc_id", "rep", words.cast("long").alias("n"), (F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int") + F.col("text").rlike(r"[\x20\x09-\x0D]\z").cast("int")).alias("ends"))
    whole = whole.withColumn("n", F.col("n") - F.col("ends")).filter(F.col("n") >= least)
    whole = whole.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("n_words"), F.col("rep").alias("src_doc_id"), F.lit(0).cast("long").alias("src_start"), F.col("n").alias("src_n_words"), F.lit(1.0).alias("similarity"))
    return near.unionByName(whole).distinct()


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the (start, words) spans and the white space behind each."""
    words = [m.span() for m in _WORD.finditer(text)]
    drop = np.zeros(len(words) + 1, np.int64)
    for start, n in spans:
        if start < len(words):
            drop[start] += 1
            drop[min(start + n, len(words))] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(text[at : words[lo][0]])
        at = words[hi][0] if hi < len(words) else len(text)
    out.append(text[at:])
    return b"".join(out)


def remove(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the passages; texts that lose all their words go."""
    spans = cut(found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n_words")).alias("__spans")))  # at most a text's own passages

    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text_column):
            texts, keep = [], []
            for text, spans in zip(batch.column(text_column).cast(pa.binary()).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                if spans and text:
                    text = remove_spans(text, [(s["start"], s["n_words"]) for s in spans])
                    keep.append(bool(text.strip(b" \t\n\v\f\r")))
                else:
                    keep.append(True)
                texts.append(text)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if f.name == text_column else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(keep))

    joined = docs.join(bounded_broadcast(spans.select(F.col("doc_id").alias("__id"), "__spans"), FEW_IDS // 4), F.col(id_column) == F.col("__id"), "left").select(*docs.columns, "__spans")
    return joined.mapInArrow(run, schema)
