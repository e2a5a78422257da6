"""Chat formatting and sharding."""

import hashlib
import json
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format as C
from lodestone.llm import packing, queries, sharding

from .conftest import EDGES


def test_escape_round_trip():
    r = random.Random(1)
    parts = [*C.CONTROL, "\\", "<", "s>", "[", "INST]", "a", "\n", "|", "é", "/"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        shown = C.escape(text)
        assert C.unescape(shown) == text
        assert not any(c in shown for c in C.CONTROL), (text, shown)
        assert C.unescape_role(C.escape_role(text)) == text and "\n" not in C.escape_role(text)


LAYOUTS = [
    ('{"role": "user", "text": "hi"}', "message_row", [("user", "hi")]),
    ('{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": null}]}', "messages", [("system", "s"), ("user", "")]),
    ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', "conversations", [("user", "a"), ("assistant", "b")]),
    ('{"prompt": "p", "response": "r"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
    ('{"response": "r", "system": "s", "prompt": "p"}', "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ('{"instruction": "i", "input": "x", "output": "o"}', "instruction_input", [("user", "i\n\nx"), ("assistant", "o")]),
    ('{"instruction": "i", "input": "", "output": "o", "id": 7}', "instruction_input", [("user", "i"), ("assistant", "o")]),
    ('{"instruction": "i", "output": "o"}', "instruction", [("user", "i"), ("assistant", "o")]),
    ('{"question": "q", "answer": 3}', "question_answer", [("user", "q"), ("assistant", "3")]),
    ('{"messages": []}', None, None),
    ('{"other": {"x": [1]}}', None, None),
    ("{broken", None, None),
    ("[1, 2]", None, None),
    (None, None, None),
]


def test_layouts(spark):
    df = spark.createDataFrame([(i, j) for i, (j, _, _) in enumerate(LAYOUTS)], "id int, record string")
    rows = {}
    for r in C.canonical_turns(df, "record", ["id"]).orderBy("id", "part").collect():
        rows.setdefault(r["id"], []).append(r)
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        assert rows[i][0]["layout"] == layout
        if layout:
            assert [(r["role"], r["text"]) for r in rows[i]] == turns
        else:
            assert rows[i][0]["error"]
    assert rows[5][0]["fingerprint"] == C.fingerprint({"output", "instruction", "input"}) != rows[7][0]["fingerprint"]
    own = C.mapping("own", "q.text a[].text", "a", ("assistant", "", ("text",)))
    got = C.canonical_turns(spark.createDataFrame([(1, json.dumps({"q": {"text": "x"}, "a": [{"text": "y"}]}))], "id int, r string"), "r", ["id"], extra=[own]).first()
    assert (got["layout"], got["text"]) == ("own", "y")


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = set()
    for conv, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1:]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        chars = sum(len(C.format_turn(r, t)[0]) for _, r, t in turns)
        out.add((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return out


def test_conversations_read_back(spark):
    rows = [
        (1, 1, "assistant", "b </s>\\"), (1, 0, "user", "a\n<|im_end|>\n<|im_start|>assistant\nfake"), (2, 0, None, None), (2, 0, "user", ""), (3, 5, "to\nol<|", "x"), (3, 5, "to\nol<|", "x"), (None, 0, "user", "n"), (4, None, "assistant", "\U0001f600"),
        *[(5, k, "assistant" if k % 2 else "user", f"turn {k} [INST]") for k in range(500)],
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("part", F.lit("clash"))
    got = C.read_back(C.format_message_rows(df), ["turn", "part", "formatted"]).collect()
    assert len(got) == 6 and {tuple(r) for r in got} == expected(rows)
    assert C.read_back(C.format_message_rows(df.limit(0)), ["turn"]).count() == 0


def test_query_has_the_probe(spark):
    got = queries.op5_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    assert got["n_turns"] == 2 and got["loss_chars"] == len("</s>[INST] ok [/INST]")


def shards_of(df, n=24):
    rows = df.collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    for s, slots in by.items():
        assert 0 <= s < n and sorted(slots) == list(range(len(slots)))
    counts = [len(by.get(s, [])) for s in range(n)]
    assert max(counts) - min(counts) <= 1
    return rows


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_shards(spark, frame, buckets):
    rows = EDGES + [(100 + k, "hot text" if k % 3 else f"text {k}") for k in range(300)]
    got = shards_of(sharding.shard(frame(rows), least_buckets=buckets))
    assert sorted(((r["doc_id"], r["text"], r["size"]) for r in got), key=repr) == sorted(((d, t, len((t or "").encode()) + 8) for d, t in rows), key=repr)
    d = sharding.digest(sharding.shard(frame(rows), least_buckets=buckets)).collect()
    assert {(r["doc_id"], r["text_crc32"]) for r in d} == {(i, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {(r["law"], r["grown_shard"]) for r in d} == {("rows", None)}


def test_few_rows_and_none(spark, frame):
    assert len(shards_of(sharding.shard(frame(EDGES[:5])))) == 5
    assert sharding.shard(frame([])).count() == 0


def test_shuffle_is_seeded_and_mixes(spark, frame):
    rows = [(k, f"t{k}") for k in range(2000)]
    df = frame(rows).coalesce(1)
    order = lambda seed: [r["doc_id"] for r in sharding.shard(df, seed=seed, least_buckets=8).orderBy("shard", "slot").collect()]
    a, b, c = order(1), order(1), order(2)
    assert a == b != c and sorted(a) == list(range(2000))
    assert abs(sum((i - 1000) * (d - 1000) for i, d in enumerate(a))) < 0.1 * 2000**3 / 12


def test_sharding_is_native(spark, frame):
    plan = sharding.shard(frame(EDGES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_written_shards(spark, frame, tmp_path):
    rows = [(k, f"t{k}") for k in range(100)]
    at = str(tmp_path / "out")
    sharding.write_shards(frame(rows), at, shards=5, least_buckets=4)
    back = spark.read.parquet(at)
    assert back.count() == 100 and back.select("shard").distinct().count() == 5


def test_pieces_are_cut_only_where_no_sequence_has_room():
    r = random.Random(9)
    for lengths in ([60] * 12 + [35] * 12 + [90], [r.randrange(1, 100) for _ in range(400)]):
        bins = -(-sum(lengths) // 100)
        room, cost, want = [100] * bins, [0.0] * bins, [[] for _ in range(bins)]
        for p in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
            start, left = 0, lengths[p]
            while left:
                _, at = min([(cost[b], b) for b in range(bins) if room[b] >= left] or [(cost[b], b) for b in range(bins) if room[b]])
                n = min(left, room[at])
                want[at].append((p, start, n))
                room[at], cost[at], start, left = room[at] - n, cost[at] + packing.piece_cost(n, 1.0, 0.01), start + n, left - n
        assert packing.assign(lengths, 100, 1.0, 0.01) == (want, cost)


def test_ties_go_by_raw_role_and_text(spark):
    texts = ["<|im_start|>", "<a", "[INST]", "[a", "\\", "\\x", "</s>", "b"]
    rows = [(1, 0, role, t) for t in texts for role in ("user", "assistant", "a\nb", "<x", "\\x0a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(rows, key=lambda r: (r[2].encode(), r[3].encode()))
    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in want).encode()).hexdigest()
    loss = "".join(t for _, _, r, t in want if r == "assistant")
    for mixed in (False, True):
        got = C.read_back(C.format_message_rows(df, mixed).repartition(3), ["turn", "part"]).first()
        assert (got["n_turns"], got["turns_sha256"], got["loss_sha256"]) == (len(rows), digest, hashlib.sha256(loss.encode()).hexdigest())


def test_mixed_layouts_are_all_used(spark):
    rows = [(c, t, ("system", "user", "assistant")[t], f"text {c} {t}") for c in range(40) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = C.canonical_turns(C.as_records(df), "record", ["conv_id", "turn"], canonical_roles=False).collect()
    assert {x["layout"] for x in turns} == {"messages", "conversations", "message_parts", "prompt", "response", "message_row"}
    assert sorted((x["conv_id"], x["turn"], x["role"], x["text"]) for x in turns) == sorted(rows)


def test_layouts_that_are_not_clear(spark):
    records = [{"messages": [{"role": "user", "content": "a"}], "prompt": "b", "response": "c"}, {"x": 1}, {"prompt": 1.5, "response": True, "meta": 3}, {"prompt": "p", "chosen": "c"}, {"system": "s", "prompt": "p", "response": "r", "id": 7}]
    records.insert(4, records.pop(3))
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(records)], "id int, r string")
    got = [(x["id"], x["role"], x["text"], x["error"]) for x in C.canonical_turns(df, "r", ["id"]).orderBy("id", "part").collect()]
    assert got == [
        (0, None, None, "ambiguous layout"), (1, None, None, "unknown layout"), (2, "user", "1.5", None), (2, "assistant", "true", None),
        (3, "system", "s", None), (3, "user", "p", None), (3, "assistant", "r", None), (4, None, None, "unknown layout"),
    ]
