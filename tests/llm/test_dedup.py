"""Near-duplicates and passages against brute force."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, minhash_dedup, substring_dedup, vector_dedup

from .conftest import EDGES


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_connected_components(spark, shape):
    r = random.Random(1)
    links = {"chain": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(50)], "random": [(r.randrange(100), r.randrange(100)) for _ in range(70)], "empty": []}[shape]
    got = {x["node"]: x["component"] for x in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({n for e in links for n in e}, links)
    assert {n: got.get(n, n) for n in want} == want


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def shingles(text, width):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return set(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else ({tuple(w)} if w else set())


def edited(r, base, n):
    w = base.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    """Bases with copies and edits of many degrees, a large group of near copies, one hot group of exact copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows, k = list(EDGES), 100
    for _ in range(12):
        base = " ".join(word() for _ in range(r.choice([3, 30, 120])))
        for n in range(8):
            rows.append((k, edited(r, base, r.randrange(0, 4)) if n else base.upper() if r.random() < 0.3 else base))
            k += 1
    base = " ".join(word() for _ in range(140))
    rows += [(k + i, edited(r, base, r.randrange(0, 8))) for i in range(120)]
    rows += [(k + 200 + i, "hot copy of one text") for i in range(60)]
    return rows


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 512), (5, 80, 16)])
def test_near_duplicates(spark, frame, monkeypatch, width, percent, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rows = corpus(width)
    got = minhash_dedup.near_duplicates(frame(rows), width, percent).collect()
    assert len(got) == len(rows)
    sets = {d: shingles(t, width) for d, t in rows if d is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0]
    want = components(sets, links)
    for x in got:
        if x["doc_id"] is None:
            assert x["component_id"] is None and x["kept"]
        else:
            assert (x["n_shingles"], x["component_id"], x["kept"]) == (len(sets[x["doc_id"]]), want[x["doc_id"]], want[x["doc_id"]] == x["doc_id"]), x
    assert len(set(want.values())) < len(want) - 60


def test_near_duplicates_of_nothing(spark, frame):
    assert minhash_dedup.near_duplicates(frame([])).count() == 0
    assert {x["kept"] for x in minhash_dedup.near_duplicates(frame([(1, None), (2, "")])).collect()} == {True}


def test_odd_sketches_follow_similarity():
    r = random.Random(2)
    base = " ".join(f"w{k}" for k in range(400))
    texts = [base.encode(), edited(r, base, 3).encode(), edited(r, base, 60).encode(), " ".join(f"v{k}" for k in range(400)).encode()]
    _, _, odd = minhash_dedup.signatures(*minhash_dedup.distinct_sets(texts, 3))
    bits = [int(np.bitwise_count(odd[0] ^ o).sum()) for o in odd]
    assert bits[0] == 0 < bits[1] < minhash_dedup.reach(85) < bits[2] < bits[3]


def test_shingle_hashes_are_exact():
    texts = [b"a b c d", b"b c d", b"", b"a b", b"a b", b"b a"]
    words_, starts = common.word_hashes(texts)
    h, first = common.shingle_hashes(words_, starts, 3)
    own = [h[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert list(map(len, own)) == [2, 1, 0, 1, 1, 1] and own[0][1] == own[1][0] and own[3] == own[4] != own[5]


def unit(v):
    return v / np.linalg.norm(v)


def vectors(seed, clump):
    r = np.random.default_rng(seed)
    rows = [(None, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [0.0] * 16, 1), (4, [None, *[1.0] * 15], 1), (5, [float("nan"), *[1.0] * 15], 1), (6, [1.0] * 16, None), (7, [1.0] * 16, 2), (8, [2.0] * 16, 2), (9, [1.0] * 8, 2), (10, [float("inf"), *[1.0] * 15], 2)]
    k = 100
    centre = unit(r.normal(size=16))
    for i in range(clump):
        rows.append((k, (centre + 0.03 * r.normal(size=16) / 4 * (1 + i % 3)).tolist(), 3))
        k += 1
    for _ in range(60):
        base = r.normal(size=16)
        for _ in range(int(r.integers(1, 5))):
            rows.append((k, (unit(base) + 0.08 * r.normal(size=16) / 4).tolist(), int(r.integers(3, 5))))
            k += 1
    rows += [(k + i, centre.tolist(), 3) for i in range(20)]
    return rows


def brute_vectors(rows, least):
    good = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a[0], b[0]) for a, b in itertools.combinations(good, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= least]
    n = collections.Counter(x for e in links for x in e)
    return n, components([i for i, _, _ in rows if i is not None], links)


@pytest.mark.parametrize(("shard", "per_cell"), [(2048, 1024), (64, 40)])
def test_near_vectors(spark, shard, per_cell):
    rows = vectors(1, 200)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = vector_dedup.near_vectors(df, 0.98, shard=shard, per_cell=per_cell).collect()
    assert len(got) == len(rows)
    n, want = brute_vectors(rows, 0.98)
    found = sum(x["n_links"] for x in got)
    assert 0.99 * sum(n.values()) <= found <= sum(n.values())
    for x in got:
        if x["vec_id"] is None:
            assert x["n_links"] == 0 and x["kept"]
        else:
            assert x["n_links"] <= n[x["vec_id"]] and x["kept"] == (x["component_id"] == x["vec_id"])
    wrong = [x for x in got if x["vec_id"] is not None and x["component_id"] != want[x["vec_id"]]]
    assert len(wrong) <= 0.01 * len(rows)


def test_near_vectors_across_cells(spark, monkeypatch):
    eye = np.eye(20)
    monkeypatch.setattr(vector_dedup, "centroids", lambda x, k: eye[:2])
    along, over = (eye[0] + eye[1]) / 2**0.5, (eye[0] - eye[1]) / 2**0.5
    rows = [(k, eye[k].tolist(), 1) for k in range(2, 20)] + [(30 + k, ((1 - 0.095**2) ** 0.5 * along + s * 0.095 * over).tolist(), 1) for k, s in enumerate((1, -1))]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.98, per_cell=8).collect()
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in got if x["n_links"]} == {30: (1, 30), 31: (1, 30)}


def test_near_vectors_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    one = vector_dedup.near_vectors(spark.createDataFrame([(1, [1.0], 1)], schema)).collect()
    assert [tuple(x) for x in one] == [(1, 0, 1, True)]


def test_graph_search_recall():
    r = np.random.default_rng(3)
    x = np.stack([unit(v) for v in np.concatenate([r.normal(size=(500, 24)), np.repeat(r.normal(size=(10, 24)), 20, 0) + 0.02 * r.normal(size=(200, 24))])])
    nbrs = vector_dedup.build_graph(x)
    assert max(map(len, nbrs)) < 300
    q, n = vector_dedup.range_search(x, nbrs, x, 0.98, 32)
    truth = set(zip(*np.nonzero(x @ x.T >= 0.98), strict=True))
    got = set(zip(q.tolist(), n.tolist(), strict=True))
    assert got <= truth and len(got) >= 0.97 * len(truth) and len(got) == len(q)


def brute_windows(values, least):
    """All (left, centre, right) of a recursion over the minimum."""
    out = []

    def split(lo, hi):
        if hi - lo + 1 >= least:
            c = lo + int(np.argmin(values[lo : hi + 1]))
            out.append((lo, c, hi))
            split(lo, c - 1)
            split(c + 1, hi)

    split(0, len(values) - 1)
    return sorted(out)


def test_compact_windows():
    r = np.random.default_rng(4)
    texts = [r.permutation(n).astype(np.uint64) for n in (0, 3, 8, 9, 50, 200)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for least in (1, 2, 8, 9):
        text, left, centre, right = substring_dedup.compact_windows(np.concatenate(texts), first, least)
        for k, t in enumerate(texts):
            assert sorted(zip(left[text == k].tolist(), centre[text == k].tolist(), right[text == k].tolist(), strict=True)) == brute_windows(t, least)


def test_passages(spark, frame):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    fill = lambda n: " ".join(word() for _ in range(n))
    shared, line = fill(70), fill(10)
    near = edited(r, shared, 1)
    rows = [
        (10, f"{fill(40)} {shared} {fill(30)}"), (11, f"{fill(20)}\n{shared}\n{fill(60)}"), (12, f"{near} {fill(90)}"), (13, fill(300)), (14, " ".join(shared.split()[:40]) + " " + fill(80)),
        *[(20 + k, f"{fill(40)} {line} {fill(40)}") for k in range(30)], (60, "exact " + shared[::-1] + fill(60)), *[(61 + k, fill(1) + " same " + " ".join(["s%d" % j for j in range(60)])) for k in range(2)],
    ]
    copy = fill(80)
    rows += [(80, copy), (81, copy), (82, "  " + copy + " "), *[e for e in EDGES if e[0] not in (9, 10)], (9, "long " * 20000), (90, "long " * 20000)]
    got = substring_dedup.passages(frame(rows)).collect()
    text = {d: words(t) for d, t in rows}
    by = collections.defaultdict(set)
    for x in got:
        assert x["src_doc_id"] < x["doc_id"] and x["n_words"] >= 50
        a, b = text[x["doc_id"]][x["start"] :][: x["n_words"]], text[x["src_doc_id"]][x["src_start"] :][: x["src_n_words"]]
        sa, sb = set(zip(*(a[k:] for k in range(5)), strict=False)), set(zip(*(b[k:] for k in range(5)), strict=False))
        assert abs(len(sa & sb) / len(sa | sb) - x["similarity"]) < 1e-9 and x["similarity"] >= 0.8
        by[x["doc_id"]].add((x["start"], x["n_words"], x["src_doc_id"]))
    assert set(by) == {11, 12, 62, 81, 82, 90}
    assert (20, 70, 10) in by[11] and by[81] == {(0, 80, 80)} and (0, 80, 80) in by[82]
    left = {x["doc_id"]: x["text"] for x in substring_dedup.remove(frame(rows), substring_dedup.passages(frame(rows))).collect()}
    assert words(left[11]) == text[11][:20] + text[11][90:] and left[10] == dict(rows)[10] and 81 not in left and left[13] == dict(rows)[13]
    assert substring_dedup.passages(frame([])).count() == 0 and substring_dedup.passages(frame([(1, "short"), (2, "short")])).count() == 0


@pytest.mark.parametrize(("block", "split", "common"), [(2048, 8, 40), (16, 1, 45), (16, 1, 10), (16, 8, 45)])
def test_passages_in_mixed_groups(spark, frame, monkeypatch, block, split, common):
    """Pairs whose passage holds a quote that many other texts have in other contexts, and a family of near copies of a passage."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    monkeypatch.setattr(substring_dedup, "SPLIT", split)
    r = random.Random(6)
    fill = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    quote, family = fill(common), fill(60)
    inner = [f"{fill((61 - common) // 2)} {quote} {fill((60 - common) // 2)}" for _ in range(40)]
    texts = [f"{fill(30)} {p} {fill(30)}" for p in inner * 2] + [f"{fill(30)} {quote} {fill(60)}" for _ in range(60)]
    texts += [f"{fill(20)} {family} {x} {fill(20)}" for x in [fill(55) for _ in range(12)] * 2]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = collections.defaultdict(set)
    for x in substring_dedup.passages(frame(rows)).collect():
        got[x["doc_id"]].update(range(x["start"], x["start"] + x["n_words"]))
    wanted = 0
    seen: set = set()
    for d, text in rows:
        w = text.split()
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        want = {p for k, run in enumerate(runs) if run in seen for p in range(k, k + 50)}
        assert want <= got[d], (d, sorted(want - got[d]))
        assert bool(want) or not got[d]
        wanted += bool(want)
        seen.update(runs)
    assert wanted == 40 + 23


def test_windows_do_not_depend_on_batches(frame):
    r = random.Random(7)
    fill = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    line = fill(20)
    rows = [(k, f"{fill(40)} {line} {fill(40)}") for k in range(40)]
    made = lambda n: {tuple(x) for x in substring_dedup.windows(frame(rows).repartition(n).select("doc_id", "text"), 50).select("key", "doc_id", "at", "ext").collect()}
    assert made(1) == made(40)


def test_remove_spans():
    text = b" a b\nc  d e "
    assert substring_dedup.remove_spans(text, [(1, 2)]) == b" a d e "
    assert substring_dedup.remove_spans(text, [(0, 2), (1, 3)]) == b" e "
    assert substring_dedup.remove_spans(text, [(0, 9)]) == b" " and substring_dedup.remove_spans(b"", [(0, 1)]) == b""


def test_near_vectors_of_any_scale(spark):
    rows = [(1, [1e-200, 2e-200], "a"), (2, [1e200, 2e200], "a"), (3, [1.0, 2.0], "b"), (4, [5e-324, 1e-323], "a"), (5, [1.0, -2.0], "a")]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), 0.98).collect()
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in got} == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1), 5: (0, 5)}


def test_blocks_hold_each_pair_across_components_once(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rows = [(9, d, 1 if d < 150 else d, [0], [0]) for d in range(170)] + [(7, d, 1 + d % 2, [0], [0]) for d in range(20)]
    dealt = minhash_dedup.dealt(spark.createDataFrame(rows, "key long, doc_id long, comp long, bands array<long>, odd array<long>")).collect()
    met = collections.Counter()
    groups = collections.defaultdict(list)
    for x in dealt:
        groups[x["key"], x["i"], x["j"]].append(x)
    for (key, i, j), xs in groups.items():
        met.update((key, *sorted((x["doc_id"], y["doc_id"]))) for x in xs for y in xs if x["own"] == i and y["own"] == j and x["comp"] != y["comp"] and (i != j or x["doc_id"] < y["doc_id"]))
    comp = {(k, d): c for k, d, c, *_ in rows}
    want = {(k, a, b) for k, a in comp for k2, b in comp if k == k2 and a < b and comp[k, a] != comp[k, b]}
    assert set(met) == want and set(met.values()) == {1}
    assert sum(x["key"] == 9 for x in dealt) <= 150 * 3 + 20 * 22


def test_vectors_without_clusters_ship_few_copies(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SMALL", 0)
    r = np.random.default_rng(6)
    base = r.normal(size=(5000, 64))
    x = np.concatenate([base, base[:600] + r.uniform(0.01, 0.2, (600, 1)) * r.normal(size=(600, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    shipped, linked = [], vector_dedup.linked

    def counted(placed, *a):
        shipped.append(placed.selectExpr("avg(1 + size(visits))").first()[0])
        return linked(placed, *a)

    monkeypatch.setattr(vector_dedup, "linked", counted)
    got = {g["vec_id"]: g["n_links"] for g in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.98, per_cell=20).collect()}
    want, _ = brute_vectors(rows[:600] + rows[5000:], 0.98)
    assert len(got) == len(rows) and all(n <= want[k] for k, n in got.items())
    assert sum(got.values()) >= 0.97 * sum(want.values()) and sum(want.values()) > 400
    assert len(shipped) == 1 and 1 < shipped[0] < 1.2 * vector_dedup.COPIES


def test_chains_test_no_stretch_that_is_too_sparse(monkeypatch):
    r = np.random.default_rng(8)
    a = r.choice(1 << 40, 4000, replace=False).astype(np.uint64)
    b = r.choice(1 << 40, 4000, replace=False).astype(np.uint64) + np.uint64(1 << 41)
    b[::3] = a[::3]  # a third in common everywhere, and two passages
    b[1000:1060], b[2000:2100] = a[1000:1060], a[2000:2100]
    asked, intersect = [], np.intersect1d
    monkeypatch.setattr(np, "intersect1d", lambda *x, **k: asked.append(1) or intersect(*x, **k))
    got = substring_dedup.chains(a, b, 46, 80)
    assert [(s <= 1000 and s + n >= 1060, s <= 2000 and s + n >= 2100) for s, n, *_ in got] == [(True, False), (False, True)]
    assert all(j >= 0.8 for *_, j in got) and len(asked) <= 40


def test_grouped_slices_and_held_groups_are_the_same():
    import pyarrow as pa

    r = np.random.default_rng(9)
    key = np.sort(r.integers(0, 300, 2000))
    table = pa.table({"key": key, "x": r.integers(0, 99, 2000), "l": pa.array([None if n == 9 else list(range(n)) for n in r.integers(0, 10, 2000)], pa.list_(pa.int64()))})
    fn = lambda g: [pa.array(g["key"][:1]), pa.array([int(g["x"].sum())]), pa.array([int(g["l"][0].sum()) + 1000 * int(g["l"][1][-1])])] if g["key"][0] % 7 else None
    want = [(k, sum(p["x"] for p in ps), sum(sum(p["l"] or []) + 1000 * len(p["l"] or []) for p in ps)) for k, ps in ((k, [p for p in table.to_pylist() if p["key"] == k]) for k in np.unique(key).tolist()) if k % 7]
    for size in (1, 3, 64, 2000):
        made = list(common._grouped(iter(table.to_batches(size)), table.column_names, ["key"], fn, ["key", "x", "l"]))
        assert [tuple(x.values()) for m in made for x in m.to_pylist()] == want and len(made) <= 2
