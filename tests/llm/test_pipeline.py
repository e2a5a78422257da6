"""The pipeline against a brute-force version of its stages."""

import itertools
import random
import re

import pytest

from lodestone.llm import queries

from .test_dedup import components, edited, shingles
from .test_filters import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    fill = lambda n: " ".join(word() for _ in range(n))
    rows, shared = [], fill(80)
    for k in range(40):
        text = fill(r.randint(60, 160))
        if k % 5 == 0:
            text = f"{text} {shared} {fill(70)}"
        if k % 7 == 0:
            text += f' token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}" end'
        rows.append((k, text))
    rows += [(100 + k, rows[k][1] if k % 2 else edited(r, rows[k][1], 1)) for k in range(10)]
    rows += [(200, "too short"), (201, "again and again " * 40), (202, None), (203, "")]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at), rows


def test_stages(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, left = docs.columns, dict(rows)
    quality, near, passages, secrets, pack = (f for _, f in corpus_pipeline.STAGES)

    docs = quality(spark, docs, at)
    left = {d: t for d, t in left.items() if brute(t, 10)[0] >= 50 and 100 * brute(t, 10)[4] <= 50 * brute(t, 10)[0]}
    assert {r["doc_id"] for r in docs.collect()} == set(left) and docs.columns == columns

    docs = near(spark, docs, at)
    sets = {d: shingles(t, 5) for d, t in left.items()}
    root = components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    left = {d: t for d, t in left.items() if root[d] == d}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == left and docs.columns == columns

    docs = passages(spark, docs, at)
    first = {}
    for d in sorted(left):
        w = left[d].split()
        gone = set()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if first.setdefault(k, d) != d:
                gone |= set(range(i, i + 50))
        left[d] = " ".join(x for i, x in enumerate(w) if i not in gone)
    assert {r["doc_id"]: " ".join(r["text"].split()) for r in docs.collect()} == left and docs.columns == columns

    docs = secrets(spark, docs, at)
    left = {d: re.sub(r"\b[0-9a-f]{40}\b", "[SECRET]", t) for d, t in left.items()}
    assert {r["doc_id"]: " ".join(r["text"].split()) for r in docs.collect()} == left and docs.columns == columns

    pieces = pack(spark, docs, at).collect()
    assert {p["doc_id"] for p in pieces} == set(left)


def test_run(spark, folder):
    at, _ = folder
    out = corpus_pipeline.run(spark, at)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


def test_every_query_runs(spark):
    for name, run in queries.QUERIES.items():
        df = run(spark, "/root/testdata/sf0.001")
        assert df.count() >= (name != "op2_secret_scan"), name  # these few rows hold no secret
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES} == {str(k) for k in range(1, 11)}
