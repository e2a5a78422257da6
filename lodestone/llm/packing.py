"""Cost-balanced packing of token sequences.

Every document is tokenised once, full windows of ``capacity`` tokens become
sequences of their own, and what remains is packed per group of about
``group_tokens`` tokens: pieces in descending length go to the sequence with the
lowest estimated cost (``linear * n + quadratic * n * n`` per piece, since attention
stays inside a document) that still has room; a piece that fits in none is cut.  A group opens ceil(tokens / capacity) sequences, so it pads
by less than one sequence.

All of it happens in one pass over the input partitions: no shuffle, and a task
holds one group of pieces at a time, whatever the size of its documents' source.
A retried task reads the same split in the same order and so gives the same rows.

Defined results: null or empty text gives the closing id alone; control strings in a text
get the ids that the library gives them; a text of any length is cut into full windows
and one rest; pieces of equal length go in the order of the input, and of sequences with
equal cost the first takes the piece; repeated rows (and repeated or null ids) are packed
each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import claim, small_batches, text_chunks, texts_of

CAPACITY, END_ID = 2048, 1
GROUP_TOKENS = 4 << 20
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64()), ("ids", pa.binary())])


class ChunkIds(dict):
    """White-space-delimited chunk -> packed ids.

    The vocabulary's normaliser collapses white space and its splitter drops it, so no
    token crosses white space and a text's ids are its chunks' ids in a row.
    """

    LIMIT = 600_000
    #: Words that are encoded in one call, and such of which normaliser and splitter leave every one as it is.
    TOGETHER, PLAIN = 1000, re.compile("[a-zß-öø-ÿ]+")
    #: Closing marks that are a match of their own behind a letter (an apostrophe may not be).
    STOPS = b".,;:!?*#$%&)"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: For plain words: the same model without normaliser, cutting at white space; and which ids end a word.
        self.words = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [[t["type"] for t in (spec[k] or {}).get(f"{k.replace('_', '')}s", [])] for k in ("normalizer", "pre_tokenizer")]
        if steps == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]:
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.words.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: The vocabulary's control strings: the library gives their ids wherever a text holds them.
        self.control = re.compile(b"|".join(re.escape(t.content.lower().encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")

    def __missing__(self, chunk: bytes) -> bytes:
        """Case and closing stops are taken off first where that can't change the ids, so that fewer words are encoded.

        The normaliser lower-cases, and stops behind a letter are a match of their own.
        """
        low = chunk.lower()
        if self.control.search(low):  # told by their exact letters, before the normaliser
            out = self.library(chunk)
        elif low != chunk and (chunk.isascii() or is_normalized("NFC", chunk.decode("utf-8", "replace"))):
            out = self[low]
        elif (base := chunk.rstrip(self.STOPS)) != chunk and (base[-1:].isalpha() or base.decode("utf-8", "replace")[-1:].lower().isalpha()):
            out = self[base] + self[chunk[len(base) :]]
        else:
            out = self.library(chunk)
        self[chunk] = out
        return out

    def library(self, chunk: bytes) -> bytes:
        return np.array(self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: Iterable[bytes]) -> None:
        """Encode the plain words of new chunks, many in one call; the ids that end a word tell them apart."""
        if not self.words:
            return
        new = {c.lower().rstrip(self.STOPS) for c in chunks}
        new = [w for w in (b.decode("utf-8", "replace") for b in new if b not in self) if self.PLAIN.fullmatch(w)]
        for lo in range(0, len(new), self.TOGETHER):
            some = new[lo : lo + self.TOGETHER]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(some) and cuts[-1] == len(ids):  # otherwise each is encoded for itself
                packed = ids.tobytes()
                for word, a, b in zip(some, [0, *cuts], cuts, strict=False):
                    self[word.encode()] = packed[4 * a : 4 * b]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > self.LIMIT:
            self.clear()
        parts = [text.split() for text in texts]
        self.learn({chunk for part in parts for chunk in part if chunk not in self})
        return [b"".join(map(self.__getitem__, part)) for part in parts]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


_KNOWN: dict[str, ChunkIds] = {}


def piece_cost(n: int, linear: float, quadratic: float) -> float:
    return linear * n + quadratic * n * n


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[list[tuple[int, int, int]]], list[float]]:
    """Pack pieces, cutting where needed: per sequence its (piece, start, length) in order, and each sequence's cost."""
    bins = -(-sum(lengths) // capacity)
    content: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    room, cost = [capacity] * bins, [0.0] * bins
    # a heap of the sequences of each room, and a tree of the heaps' minima
    leaves = 1 << capacity.bit_length()
    none = (float("inf"), -1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(leaves)]
    tree = [none] * (2 * leaves)

    def renew(r: int) -> None:
        k = leaves + r
        tree[k] = heaps[r][0] if heaps[r] else none
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def cheapest(least: int) -> int:
        """The cheapest sequence with that much room, or -1."""
        k = leaves + least
        best = tree[k]
        while k > 1:
            if not k & 1:
                best = min(best, tree[k + 1])
            k >>= 1
        return best[1]

    heaps[capacity] = [(0.0, b) for b in range(bins)]
    renew(capacity)
    for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        start, left = 0, lengths[piece]
        while left:
            at = cheapest(left) if left <= capacity else -1
            if at < 0:  # no sequence has room for all of it: cut at the cheapest one
                at = cheapest(1)
            n = min(left, room[at])
            heapq.heappop(heaps[room[at]])
            renew(room[at])
            content[at].append((piece, start, n))
            room[at] -= n
            cost[at] += piece_cost(n, linear, quadratic)
            if room[at]:
                heapq.heappush(heaps[room[at]], (cost[at], at))
                renew(room[at])
            start, left = start + n, left - n
    return content, cost


def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, group_tokens: int, linear: float, quadratic: float) -> Iterator[pa.RecordBatch]:
    if path not in _KNOWN:
        _KNOWN[path] = ChunkIds(path)
    known = _KNOWN[path]
    claim("packing", _KNOWN.clear)
    base = TaskContext.get().partitionId() << 32
    used, held = 0, 0
    end = np.array([end_id], "<u4").tobytes()
    rest: list[tuple] = []  # doc_id, start, total, ids
    full: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal used, held, rest, full
        rows = []
        for doc, start, total, ids in full:
            rows.append((doc, start, len(ids) // 4, total, base + used, 0, piece_cost(len(ids) // 4, linear, quadratic), ids))
            used += 1
        content, cost = assign([len(r[3]) // 4 for r in rest], capacity, linear, quadratic)
        for pieces, c in zip(content, cost, strict=True):
            at = 0
            for p, s, n in pieces:
                doc, start, total, ids = rest[p]
                rows.append((doc, start + s, n, total, base + used, at, c, ids[4 * s : 4 * (s + n)]))
                at += n
            used += 1
        rest, full, held = [], [], 0
        for lo in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 4096], strict=True), ARROW, strict=True)], schema=ARROW)

    for batch in text_chunks(batches, "text"):
        for doc, ids in zip(batch.column("doc_id").to_pylist(), known.encode_all(texts_of(batch, "text")), strict=True):
            ids += end
            total = len(ids) // 4
            whole = total // capacity * capacity
            for s in range(0, whole, capacity):
                full.append((doc, s, total, ids[4 * s : 4 * (s + capacity)]))
                held += capacity
                if held >= group_tokens:
                    yield from flush()
            if whole < total:
                rest.append((doc, whole, total, ids[4 * whole :]))
                held += total - whole
        if held >= group_tokens:
            yield from flush()
    if held:
        yield from flush()


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_tokens: int = GROUP_TOKENS,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
) -> DataFrame:
    """Pack all ``docs`` into sequences of at most ``capacity`` tokens.

    ``vocabulary``: path of a word-level BPE file on every node.  Returns a row per
    piece: doc_id, start, length, doc_tokens, sequence_id, offset, cost (of its
    sequence) and ids (packed little-endian unsigned 32-bit).
    """
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(lambda it: _pack_partition(it, vocabulary, capacity, end_id, group_tokens, linear, quadratic), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with their ids' CRC-32 in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
