"""Packing and byte-level BPE against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import byte_bpe, packing
from lodestone.llm.queries import tokenizer_path

from .conftest import EDGES

WORDS, BYTES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def byte_bpe_library():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABETS = ["abcDEF", ".,!?'", "éÈßİΣσς", "é̈Ë", "日本ｆ１2", "\x1c\x85\xa0 \n\t", "K²Ⅷ", "  \n a"]


def noise(r, n):
    return "".join(r.choice(r.choice(ALPHABETS)) for _ in range(n))


def test_chunk_ids_are_the_librarys(word_bpe):
    r, known = random.Random(1), packing.ChunkIds(WORDS)
    for text in ["", "hello <|startoftext|> x", "a<|endoftext|>b. <|ENDOFTEXT|>C <|StartOfText|>. x<|startoftext|>.", "don't STOP... İ,x. <|endoftext|> KK,", *(noise(r, r.randint(1, 40)) for _ in range(3000))]:
        assert np.frombuffer(known.encode(text.encode()), "<u4").tolist() == word_bpe.encode(text, add_special_tokens=False).ids, text


def test_new_words_are_encoded_together(word_bpe):
    r, known = random.Random(2), packing.ChunkIds(WORDS)
    stems = ["".join(r.choice("aeioustrnçéèßÿlmp") for _ in range(r.randint(1, 14))) for _ in range(1500)]
    words = [s + r.choice(["", "", ".", ",", "$$$", ".%%%", "?)"]) for s in stems]
    words = [w.title() if r.random() < 0.2 else w for w in words] + ["don't.", "x's***", "a1.", "é́.", "¡hola!", "x<|endoftext|>.", "&lt;", "ſ.", "ªº"]
    calls, plain = [], known.tokenizer

    class Counted:
        def encode(self, text, **k):
            calls.append(text)
            return plain.encode(text, **k)

    known.tokenizer = Counted()
    text = " ".join(words)
    got = known.encode_all([text.encode(), b"", text.encode()])
    want = np.array(word_bpe.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert got == [want, b"", want]
    assert len(calls) < 400 and all(known[w.encode()] == np.array(word_bpe.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words)


def check_pieces(pieces, rows, tokenizer, capacity):
    want = sorted(((d, zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for d, t in rows), key=repr)
    by_sequence, by_document = {}, {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        by_document.setdefault(p["doc_id"], []).append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] == len(p["ids"]) // 4 > 0
            at += p["length"]
        assert at <= capacity
    got = []
    for d, ps in by_document.items():
        ps = sorted(ps, key=lambda p: (p["start"], p["sequence_id"]))
        copies = sum(p["start"] == 0 for p in ps)
        assert sum(p["length"] for p in ps) == copies * ps[0]["doc_tokens"] or copies > 1
        if copies == 1:
            got.append((d, zlib.crc32(b"".join(bytes(p["ids"]) for p in ps))))
    assert sorted(got, key=repr) == sorted((w for w in want if len([x for x in rows if x[0] == w[0]]) == 1), key=repr)
    return by_sequence


def test_packing_of_edges(spark, frame, word_bpe):
    pieces = packing.pack(frame(EDGES), WORDS, capacity=64, group_tokens=1000).collect()
    check_pieces(pieces, EDGES, word_bpe, 64)
    assert sum(p["length"] for p in pieces if p["doc_id"] == 6) == 2 * pieces[[p["doc_id"] for p in pieces].index(6)]["doc_tokens"]
    assert [p["length"] for p in pieces if p["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert packing.pack(frame([]), WORDS).count() == 0


def test_packing_wastes_less_than_a_sequence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    pieces = packing.pack(docs, WORDS, capacity=512).select("sequence_id", "length", "cost").collect()
    fill = {}
    for p in pieces:
        fill[p["sequence_id"]] = fill.get(p["sequence_id"], 0) + p["length"]
    assert sum(512 - v for v in fill.values()) < 512


def test_assignment_balances_cost():
    content, cost = packing.assign([5, 5, 5, 5, 1, 1, 1, 1], 6, 1.0, 1.0)
    assert len(content) == 4 and len({round(c, 6) for c in cost}) == 1 and all(sum(n for _, _, n in c) == 6 for c in content)
    assert packing.assign([], 8, 1.0, 1.0) == ([], [])
    r = random.Random(3)
    lengths = [r.randint(1, 100) for _ in range(500)]
    content, _ = packing.assign(lengths, 100, 1.0, 0.1)
    cover = {}
    for pieces in content:
        assert sum(n for _, _, n in pieces) <= 100
        for p, s, n in pieces:
            cover.setdefault(p, []).append((s, n))
    for p, spans in cover.items():
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at == lengths[p]


def test_byte_bpe_is_the_librarys(byte_bpe_library):
    import public_tokenizers

    v, r = byte_bpe.vocabulary(BYTES, public_tokenizers.PATTERN), random.Random(2)
    texts = ["", "a" * 3000, "ab" * 700, "the " * 50, *(noise(r, r.choice([1, 5, 30, 300])) for _ in range(500)), *("".join(r.choice("etaoin") for _ in range(r.choice([10, 200, 400]))) for _ in range(200))]
    for text, packed in zip(texts, v.encode(texts), strict=True):
        ids = np.frombuffer(packed, "<i4").tolist()
        assert ids == byte_bpe_library.encode_ordinary(text), text[:50]
        assert v.decode(ids) == text.encode()


def test_byte_bpe_of_overlapping_merges(tmp_path):
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"aba": 256, b"ab": 257, b"bab": 258, b"abab": 259}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    v, library = byte_bpe.Vocabulary(str(path), r"[ab]+"), tiktoken.Encoding("tiny", pat_str=r"[ab]+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    for n in [*range(1, 40), byte_bpe.LONG - 1, byte_bpe.LONG, byte_bpe.LONG + 1, 1000]:
        for text in ("ab" * n, "".join(r.choice("ab") for _ in range(n))):
            want = library.encode_ordinary(text)
            assert v.matrix([text.encode()])[0].tolist() == want and v.long_match(text.encode()).tolist() == want


def test_byte_bpe_round_trip_of_edges(spark, frame, byte_bpe_library):
    import public_tokenizers

    got = byte_bpe.round_trip(frame(EDGES), BYTES, public_tokenizers.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(ids := byte_bpe_library.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t in EDGES]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.round_trip(frame([]), BYTES, public_tokenizers.PATTERN).count() == 0


def test_pair_table():
    r = np.random.default_rng(1)
    pairs = np.unique(r.integers(0, 500, (5000, 2)), axis=0)
    t = byte_bpe.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)))
    assert (t.find(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    assert (t.find(pairs[:, 0] + 1000, pairs[:, 1]) == byte_bpe.NONE).all()
