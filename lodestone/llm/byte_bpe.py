"""Byte-level BPE encoding and decoding in numpy.

Texts are cut by the vocabulary's pattern.  Matches not seen before are grouped by
length into padded integer matrices, one match a row; each round looks up the rank
of every neighbouring pair in an open-addressing hash table, merges each row's
leftmost pair of minimum rank, and compacts the rows.  Rows that are done leave the
matrix.  A matrix takes as many rounds as a match has merges, so matches over ``LONG``
bytes do the same merges in the same order by a heap, in time n log n.

Both directions are row-local Arrow functions: no shuffle, and memory follows the
batch's bytes.

Defined results: null or empty text gives no ids, and no ids give empty bytes; of equal
ranks the leftmost pair merges first; a match of any length is encoded whole; repeated
rows are encoded each for itself, and an empty table gives no rows; decoding gives back the UTF-8 bytes of the text; other columns and their names are
left alone, and a clash with the result's name is an error of the caller's alias.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import claim, small_batches, text_chunks

NONE = np.int64(1) << 40
LONG = 256


class PairTable:
    """(left id, right id) -> merged id, by open addressing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << self.bits, NONE, np.int64)
        key = self.key(left, right)
        todo, step = np.arange(len(key)), 0
        while len(todo):
            slot = self.slot(key[todo], step)
            free = self.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(slot, return_index=True)
            wins = np.zeros(len(todo), bool)
            wins[first] = True
            wins &= free
            self.keys[slot[wins]] = key[todo[wins]]
            self.values[slot[wins]] = merged[todo[wins]]
            todo, step = todo[~wins], step + 1
        self.probes = step

    def key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def slot(self, key: np.ndarray, step: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)) + np.uint64(step)) & np.uint64((1 << self.bits) - 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair doesn't merge."""
        key = self.key(left, right).ravel()
        out = np.full(len(key), NONE, np.int64)
        todo = np.arange(len(key))
        for step in range(self.probes):
            slot = self.slot(key[todo], step)
            at = self.keys[slot]
            hit = at == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            todo = todo[~hit & (at != np.uint64(0xFFFFFFFFFFFFFFFF))]
            if not len(todo):
                break
        return out.reshape(left.shape)


class Vocabulary:
    LIMIT = 300_000

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            self.bytes[r] = token
        trio = [
            (self.ranks[token[:k]], self.ranks[token[k:]], r)
            for token, r in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        left, right, merged = (np.array(x, np.int64) for x in zip(*trio, strict=True))
        self.pairs = PairTable(left, right, merged)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.known: dict[str, bytes] = {}

    def matrix(self, matches: list[bytes]) -> list[np.ndarray]:
        """Ids of matches of similar length."""
        n = np.array([len(m) for m in matches])
        ids = np.full((len(matches), n.max()), -1, np.int64)
        flat = self.single[np.frombuffer(b"".join(matches), np.uint8)]
        ids[np.arange(ids.shape[1]) < n[:, None]] = flat
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(matches)
        row = np.arange(len(matches))
        while len(row):
            width = int(n.max())
            ids = ids[:, :width]
            if width > 1:
                rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
                rank[np.arange(1, width) >= n[:, None]] = NONE
                at = rank.argmin(1)
                best = rank[np.arange(len(row)), at]
            else:
                at, best = np.zeros(len(row), np.int64), np.full(len(row), NONE)
            done = best == NONE
            for k in np.flatnonzero(done).tolist():
                out[row[k]] = ids[k, : n[k]].copy()
            going = ~done
            row, n, ids, at, best = row[going], n[going] - 1, ids[going], at[going], best[going]
            if len(row):
                # compaction: everything right of the merged pair moves one place left
                cols = np.arange(ids.shape[1] - 1)
                moved = np.where(cols[None, :] <= at[:, None], ids[:, :-1], ids[:, 1:])
                moved[np.arange(len(row)), at] = best
                ids = moved
        return out

    def long_match(self, match: bytes) -> np.ndarray:
        """The same merges by a heap of (rank, place) over linked places."""
        parts = [match[k : k + 1] for k in range(len(match))]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, k) for k in range(n - 1) if (r := rank(match[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            right = after[k] if parts[k] else n
            if right >= n or rank(parts[k] + parts[right]) != r:
                continue  # one of its sides has been merged since
            parts[k] += parts[right]
            parts[right] = b""
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (r := rank(parts[left] + parts[after[left]])) is not None:
                    heapq.heappush(heap, (r, left))
        return np.array([self.ranks[x] for x in parts if x], np.int64)

    def learn(self, matches: set[str]) -> None:
        """Encode the matches that aren't known yet."""
        buckets: dict[int, list[str]] = {}
        for m in matches:
            raw = m.encode("utf-8", "replace")
            if raw in self.ranks:
                self.known[m] = np.array([self.ranks[raw]], "<i4").tobytes()
            elif len(raw) > LONG:
                self.known[m] = self.long_match(raw).astype("<i4").tobytes()
            else:
                buckets.setdefault((len(raw) + 3) // 4, []).append(m)
        for same in buckets.values():
            for lo in range(0, len(same), 8192):
                part = same[lo : lo + 8192]
                for m, ids in zip(part, self.matrix([m.encode("utf-8", "replace") for m in part]), strict=True):
                    self.known[m] = ids.astype("<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian ids of each text."""
        if len(self.known) > self.LIMIT:
            self.known.clear()
        cuts = [self.find(t) for t in texts]
        new: set[str] = set()
        for c in cuts:
            new.update(c)
        new.difference_update(self.known)
        self.learn(new)
        return [b"".join(map(self.known.__getitem__, c)) for c in cuts]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_LOADED: dict[tuple, Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary(path, pattern)
    claim("byte_bpe", _LOADED.clear)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text; ``path`` is the ranks' file on every node."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in text_chunks(batches, "text"):
            packed = v.encode([t or "" for t in batch.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(path: str, pattern: str):
    """A column function: array<int> ids -> binary."""

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        v = vocabulary(path, pattern)
        return pd.Series([v.decode(x.tolist()) if x is not None else b"" for x in ids], dtype=object)

    return run


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs``."""
    coded = encode(docs, path, pattern).withColumn("decoded", decode(path, pattern)("ids"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
