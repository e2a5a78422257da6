"""Toxicity scores from averaged subword embeddings.

A word stands for the mean of hashed character n-gram vectors (and its own), a text
for the mean of its words, and a linear softmax reads the label from that mean;
vectors and softmax are trained jointly in numpy.  A misspelling that was never seen
shares most of its n-grams with the word it distorts.

Training uses a bounded sample, ``MAX_TRAIN`` labelled rows of each class at most, in
the order of a hash of the id: the ids are picked from the labels alone and joined to
the texts by broadcast, so only the sample's texts are shuffled, and of those at most
``MAX_BYTES`` are learnt from, each whole.  Of texts that share an id the smallest counts.  Scoring is one pass over all texts
with the n-grams' logits (half a megabyte) shipped to the workers.

Defined results: null and empty texts have the mean vector 0 and so the score of the
intercept; texts whose id is null aren't learnt from; labels other than 0 and 1, and
null ones, are left out; where ids repeat in the labels the larger label counts;
without labels of both classes every score is the share of toxic labels (0 without
any); a text of any length is scored whole; a score of exactly 0.5 is predicted 1;
repeated rows are scored each for itself; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import claim, small_batches, text_chunks, texts_of

#: Bound of the training sample, by class.
MAX_TRAIN = 2000
#: Bytes of text of the sample.
MAX_BYTES = 64 << 20
BUCKETS, DIM, EPOCHS, RATE, BATCH, SCALE = 1 << 17, 8, 12, 0.15, 32, 30.0
SHORTEST, LONGEST = 3, 6
#: Sample texts that must have a bucket (fewer in small samples), and the decay of vectors a step.
LEAST_TEXTS, DECAY = 8, 2e-5
#: Characters of a word that a worker remembers; longer ones are scored each time.
KEPT = 64
EDGES = ".,;:!?\"'()[]{}#*$%&|<>-"


def stem(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(EDGES)


def ngrams(text: str) -> set[int]:
    """Buckets of a word and its character n-grams, with marks at both ends."""
    marked = f"<{text}>"
    # buckets at once: a long word's n-grams aren't held as strings
    grams = {zlib.crc32(marked[i : i + n].encode("utf-8", "replace")) % BUCKETS for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)}
    grams.add(zlib.crc32(marked.encode("utf-8", "replace")) % BUCKETS)
    return grams


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2
    used: np.ndarray  # BUCKETS flags

    def logits(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to a word's margin (nan: not used), and the intercept; the model is linear in the mean."""
        side = self.weights[:, 1] - self.weights[:, 0]
        margins = np.where(self.used, self.vectors @ side * SCALE, np.nan).astype(np.float32)
        return margins, float(self.bias[1] - self.bias[0])


def constant(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 2)), np.array([0.0, np.log(share / (1 - share))]), np.zeros(BUCKETS, bool))


def train(texts: list[bytes], labels: np.ndarray, prior: float, seed: int = 7) -> Model:
    """``prior``: share of label 1 among all labels; the intercept is set between it and even odds."""
    labels = np.asarray(labels, np.int64)
    share = labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:
        return constant(share)
    index: dict[bytes, int] = {}
    bags = []
    for t in texts:
        ids, count = np.unique([index.setdefault(w, len(index)) for w in t.split()] or np.zeros(0, np.int64), return_counts=True)
        bags.append((ids.astype(np.int64), count / max(1, count.sum())))
    # a bucket counts where enough sample texts have it; the others would only let single words be learnt by heart
    grams = [np.array(sorted(ngrams(stem(w))), np.int64) for w in index]
    frequency = np.zeros(BUCKETS, np.int64)
    for ids, _ in bags:
        if len(ids):
            frequency[np.unique(np.concatenate([grams[i] for i in ids]))] += 1
    used = frequency >= min(max(labels.sum() // 40, 2), LEAST_TEXTS)
    place = np.cumsum(used) - 1  # buckets in use, numbered
    grams = [place[g[used[g]]] for g in grams]
    known = np.array([len(g) > 0 for g in grams], bool)
    bags = [(ids[known[ids]], share[known[ids]].astype(np.float32)) for ids, share in bags]
    size = np.array([len(g) for g in grams], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    m = int(used.sum())
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)[used]
    weights, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    seen, seen_w, seen_b = np.full((m, DIM), 1e-6, np.float32), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 0.01
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            words = np.concatenate([bags[d][0] for d in docs])
            share_of = np.concatenate([bags[d][1] for d in docs])
            doc = np.repeat(np.arange(len(docs)), [len(bags[d][0]) for d in docs])
            unique, back = np.unique(words, return_inverse=True)
            n = size[unique]
            ends = np.cumsum(n)
            gram = flat[np.arange(n.sum()) + np.repeat(start[unique] - ends + n, n)]
            # documents x unique words, dense over the batch alone
            bag = np.zeros((len(docs), len(unique)), np.float32)
            bag[doc, back] = share_of
            word = np.add.reduceat(vectors[gram], ends - n, axis=0) / n[:, None] if len(gram) else np.zeros((0, DIM))
            mean = bag @ word * SCALE
            logit = mean @ weights + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), labels[docs]] -= 1
            p /= len(docs)
            grad_w, grad_b = mean.T @ p, p.sum(0)
            if len(gram):
                # a word's gradient has rank one per class: two weighted counts of its n-grams give those of their vectors
                side = bag.T @ p * SCALE / n[:, None]
                spread = np.repeat(side, n, axis=0)
                sums = np.stack([np.bincount(gram, spread[:, k], minlength=m) for k in range(2)], 1)
                touched = np.flatnonzero(np.bincount(gram, minlength=m))
                grad = DECAY * vectors[touched] + sums[touched] @ weights.T
                seen[touched] += grad**2
                vectors[touched] -= rate * grad / np.sqrt(seen[touched])
            seen_w += grad_w**2
            weights -= rate * grad_w / np.sqrt(seen_w)
            seen_b += grad_b**2
            bias -= rate * grad_b / np.sqrt(seen_b)
    everywhere = np.zeros((BUCKETS, DIM), np.float32)
    everywhere[used] = vectors
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    # from the sample's share to half the prior's log odds: a missed toxic text costs more than a false alarm
    bias = bias + np.array([0.0, np.log(prior / (1 - prior)) / 2 - np.log(share / (1 - share))])
    return Model(everywhere, weights, bias, used)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    return F.expr(f"pmod(crc32(cast(cast({doc_id} AS string) AS binary)), {folds}) = 0")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, most_bytes: int = MAX_BYTES) -> Model:
    """Learn from the labelled rows outside the held-out fold; ``labels``: doc_id and toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return constant(0.0)
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = known.filter("toxic = 0").orderBy(*order).limit(most).unionByName(known.filter("toxic = 1").orderBy(*order).limit(most))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = text.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))  # over 2 * most rows at most
    rows = picked.withColumn("before", F.coalesce(so_far, F.lit(0))).filter(F.col("before") + F.octet_length("text") <= most_bytes).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([(r["text"] or "").encode("utf-8", "replace") for r in rows], np.array([r["toxic"] for r in rows]), counts.get(1, 0) / sum(counts.values()))


class WordMargin(dict):
    """word -> mean margin of its n-grams that the model uses; words that differ at the edges or in case share one."""

    LIMIT = 800_000

    def __init__(self, logits: np.ndarray) -> None:
        self.logits = logits.tolist()
        self.stems: dict[str, float] = {}

    def __missing__(self, word: bytes) -> float:
        text = stem(word)
        m = self.stems.get(text)
        if m is None:
            got = [x for x in map(self.logits.__getitem__, ngrams(text)) if x == x]
            m = sum(got) / len(got) if got else 0.0
            if len(text) <= KEPT:
                self.stems[text] = m
        if len(word) <= 4 * KEPT:
            self[word] = m
        return m

    def trim(self) -> None:
        if len(self) > self.LIMIT:
            self.clear()
        if len(self.stems) > self.LIMIT:
            self.stems.clear()


_MARGINS: dict[int, WordMargin] = {}  # of the last model that a worker scored with


def margin_of(key: int, shipped: Broadcast) -> WordMargin:
    """The worker's own, kept from task to task."""
    if key not in _MARGINS:
        _MARGINS.clear()
        _MARGINS[key] = WordMargin(shipped.value)
    claim("toxicity", _MARGINS.clear)
    return _MARGINS[key]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs``, from its whole text."""
    small_batches(docs.sparkSession)
    logits, intercept = model.logits()
    key = zlib.crc32(logits.tobytes())
    shipped = docs.sparkSession.sparkContext.broadcast(logits)  # BUCKETS floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = margin_of(key, shipped)
        for batch in text_chunks(batches, "text"):
            margin.trim()
            out = []
            for t in texts_of(batch, "text"):
                words = t.split()
                mean = sum(map(margin.__getitem__, words)) / max(1, len(words))
                out.append(1 / (1 + np.exp(-np.clip(mean + intercept, -60, 60))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """Fit on the labelled rows outside the fold, score every row: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, most))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
