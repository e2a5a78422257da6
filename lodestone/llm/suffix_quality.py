"""Quality rules on repetition, by suffix arrays.

Words are factorised per batch and a suffix array over all of a batch's texts is
built by prefix doubling; each level keeps dense ranks, so the longest common prefix
of neighbouring suffixes comes from a descent through the levels.  Suffixes of two
texts never share a prefix, since ranks carry the text's number.

In the suffix array every maximal run with lcp >= l is an lcp interval and stands for
one repeated substring.  A suffix's deepest interval has lcp max(lcp before, lcp
after), and a shallower interval's spans lie inside the deeper ones at the same
starts, so the union of the spans of all maximal repeats of at least ``min_words``
words is the union of [p, p + that lcp).  The rule limits the fraction of words so
covered and the longest repeat.

Defined results: null and empty texts have no words, fail the base rule and have no
repeats; a text is judged whole whatever its length, in about 4 bytes a word and doubling;
repeated rows are judged each for itself; of equal repeats each counts; tables without rows give none; only
the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import claim, small_batches, text_chunks, texts_of

#: A repeat counts from this many words on.
MIN_WORDS = 10
#: Limits of the verdict: covered words in hundredths, and the longest repeat in words and hundredths of the text.
MAX_COVERED, MAX_LONGEST, MAX_LONGEST_SHARE = 30, 100, 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "n_maximal_repeats"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"
SPACES, SYMBOLS = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"), tuple(bytes([c]) for c in b"#*$%&|<>")


def dense(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Dense ranks of ``keys`` given the order that sorts them."""
    out = np.empty(len(keys), np.int64)
    k = keys[order]
    out[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
    return out


def suffix_array(words: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of all suffixes, lcp with the one before, and the dense ranks of two-word prefixes.

    ``words``: integers from 0; ``own``: each position's text, ascending.
    """
    n = len(words)
    levels = []
    key = own * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = dense(key, order)
    small = np.int32 if n < 2**31 else np.int64
    levels.append(rank.astype(small))
    size = np.bincount(rank, minlength=1)
    last_of = np.searchsorted(own, own, side="right")  # first position behind the text
    span, open_ = 1, np.flatnonzero(size[rank] > 1)
    while len(open_):
        # suffixes that are alone in their rank keep it; the others are split by the rank ``span`` words on
        follow = np.full(len(open_), -1, np.int64)
        inside = open_ + span < last_of[open_]
        follow[inside] = rank[open_[inside] + span]
        pair = rank[open_] * (n + 1) + follow + 1
        by = np.argsort(pair, kind="stable")
        sorted_pair, sorted_rank = pair[by], rank[open_][by]
        new_pair = np.concatenate([[True], sorted_pair[1:] != sorted_pair[:-1]])
        new_rank = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
        # ranks count the suffixes before; within a group each sub-group starts where its first member stands
        at = np.arange(len(by))
        group_start = np.maximum.accumulate(np.where(new_rank, at, 0))
        sub_start = np.maximum.accumulate(np.where(new_pair, at, 0))
        if span == 1:
            first = np.concatenate([[0], np.cumsum(size)[:-1]])  # from dense to positional ranks
            rank = first[rank]
            sorted_rank = first[sorted_rank]
        rank = rank.copy()
        rank[open_[by]] = sorted_rank + sub_start - group_start
        levels.append(rank.astype(small))
        count = np.diff(np.concatenate([np.flatnonzero(new_pair), [len(by)]]))
        open_ = np.sort(open_[by[np.repeat(count, count) > 1]])
        span *= 2
    if len(levels) == 1:
        order = np.argsort(rank, kind="stable")
    else:
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        got = np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            step = 1 << k
            ok = np.flatnonzero((a < n) & (b < n))
            same = ok[levels[k][a[ok]] == levels[k][b[ok]]]
            got[same] += step
            a[same] += step
            b[same] += step
            past = same[(a[same] >= last_of[np.minimum(order[:-1][same], n - 1)]) | (b[same] >= last_of[np.minimum(order[1:][same], n - 1)])]
            a[past], b[past] = n, n
        lcp[1:] = got
    return order, lcp, levels[1] if len(levels) > 1 else levels[0]


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, words: np.ndarray, own: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) in suffix-array ranks of each maximal repeat of at least ``least`` words.

    An interval is right-maximal as it is; it is left-maximal unless one word precedes all of its suffixes.
    """
    n = len(order)
    if not n:
        return []
    before = np.where((order > 0) & (own[np.maximum(order - 1, 0)] == own[order]), words[np.maximum(order - 1, 0)], -1 - order)
    change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    out: list[tuple[int, int, int]] = []
    hot = np.flatnonzero(lcp >= least)
    if not len(hot):
        return out
    cuts = np.flatnonzero(np.diff(hot) != 1)
    for lo, hi in zip(np.concatenate([[0], cuts + 1]).tolist(), np.concatenate([cuts, [len(hot) - 1]]).tolist(), strict=True):
        first, last = int(hot[lo]), int(hot[hi])
        values = lcp[first : last + 1].tolist()
        if len(values) == 1:
            if change[first] != change[first - 1]:
                out.append((values[0], first - 1, first))
            continue
        stack: list[tuple[int, int]] = []  # (lcp, left bound)
        for i, v in enumerate([*values, 0], first):
            left = i - 1
            while stack and stack[-1][0] > v:
                h, left = stack.pop()
                if change[i - 1] != change[left]:
                    out.append((h, left, i - 1))
            if v and (not stack or stack[-1][0] < v):
                stack.append((v, left))
    return out


def repeats(words: np.ndarray, starts: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words in 3-word windows found twice or more, words in long repeats, the longest repeat, maximal repeats."""
    docs = len(starts) - 1
    zero = np.zeros(docs, np.int64)
    if not len(words):
        return zero, zero, zero, zero
    own = np.repeat(np.arange(docs), np.diff(starts))
    order, lcp, _ = suffix_array(words, own)
    after = np.concatenate([lcp[1:], [0]])
    most = np.empty(len(words), np.int64)
    most[order] = np.maximum(lcp, after)

    def covered(length: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(length)
        step = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + length[at], minlength=len(words) + 1)
        return np.bincount(own[np.cumsum(step)[:-1] > 0], minlength=docs)

    longest = zero.copy()
    np.maximum.at(longest, own, most)
    intervals = maximal_repeats(order, lcp, words, own, least)
    count = np.bincount(own[order[[x[1] for x in intervals]]], minlength=docs) if intervals else zero
    return covered(np.where(most >= 3, 3, 0)), covered(np.where(most >= least, most, 0)), np.where(longest >= least, longest, 0), count


def counts_of(texts: list[bytes], least: int) -> list[np.ndarray]:
    """The columns of COUNTS for the texts."""
    claim("quality", int)  # keeps nothing itself
    split = [t.split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    flat = np.empty(starts[-1], object)
    flat[:] = [w for s in split for w in s]
    codes = pd.factorize(flat)[0].astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    del flat, split
    n_chars = [len(t.decode("utf-8", "replace")) - sum(map(t.count, SPACES)) for t in texts]
    symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\v\f\r")]
        dup.append(len(lines) - len(set(lines)))
    return [np.asarray(c, np.int64) for c in (np.diff(starts), n_chars, symbols, dup, *repeats(codes, starts, least))]


def verdict(n: dict[str, np.ndarray], max_covered: int, max_longest: int, max_longest_share: int) -> tuple[np.ndarray, np.ndarray]:
    """The base rule's failures, and what is kept, from the columns of COUNTS."""
    words = n["n_words"]
    failed = (words < 50) | (100 * n["n_repeat_words"] > 50 * words)
    bad = (100 * n["n_covered_words"] > max_covered * words) | ((n["longest_repeat"] > max_longest) & (100 * n["longest_repeat"] > max_longest_share * words))
    return failed, ~(failed | bad)


def judge(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_words: int = MIN_WORDS,
    max_covered: int = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
    max_longest_share: int = MAX_LONGEST_SHARE,
) -> DataFrame:
    """Counts, base rule and verdict for each row of ``docs``.

    Rejected by the method: more than ``max_covered`` hundredths of the words lie in
    repeats, or the longest repeat has over ``max_longest`` words and over
    ``max_longest_share`` hundredths of the text.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            n = dict(zip(COUNTS, counts_of(texts_of(batch, "text"), min_words), strict=True))
            made = [*n.values(), *verdict(n, max_covered, max_longest, max_longest_share)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, made)], ["doc_id", *COUNTS, "base_failed", "kept"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep(
    docs: DataFrame,
    text_column: str = "text",
    min_words: int = MIN_WORDS,
    max_covered: int = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
    max_longest_share: int = MAX_LONGEST_SHARE,
) -> DataFrame:
    """The rows of ``docs`` that base rule and verdict keep, in one pass with no join: rows are measured and dropped in place."""
    small_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "__text"):
            n = dict(zip(COUNTS, counts_of(texts_of(batch, "__text"), min_words), strict=True))
            yield batch.select(schema.names).filter(pa.array(verdict(n, max_covered, max_longest, max_longest_share)[1]))

    return docs.withColumn("__text", F.col(text_column).cast("string")).mapInArrow(run, schema)
