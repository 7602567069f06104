"""Tokenizer scan, fingerprints, classifier, chats, shards and archives."""

import base64
import hashlib
import json
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factweave.llm import chat, digest, pieces, quality, reshard, warc
from factweave.llm.common import scratch, utf8

DOCS = "doc_id long, text string"


def test_scan_equals_the_library(sf_dir):
    lib = pieces.load(pieces.MODEL).lib
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("aab  \n\te.é漢字the▁x😀1") for _ in range(rng.randint(0, 80)))
        for size in (1, 3, 17, 60):
            assert pieces.scan(text, size=size) == lib.encode(text), (text, size)


def test_encode_whole_and_giant_texts(spark):
    lib = pieces.load(pieces.MODEL).lib
    rows = [(1, None), (2, ""), (3, "Hello  wörld\n"), (4, "many words " * 200), (4, "many words " * 200), (5, "漢字" * 400), (6, " " * 700)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1))
    got = pieces.encode(docs, giant=300, chunk=97)
    assert got.columns == ["doc_id", "text", "key", "ids", "n_ids", "decoded"]
    assert sorted(((r["doc_id"], r["ids"]) for r in got.collect()), key=str) == sorted(((i, None if t is None else lib.encode(t)) for i, t in rows), key=str)
    assert all(r["decoded"] for r in got.where("text IS NOT NULL").collect())
    assert pieces.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_levels_are_entropies():
    raw = utf8(pa.array(["The quick brown fox jumps over the lazy dog, again and again, " * 3 + "a" * 90]))[0]
    for i, level in enumerate(digest.levels(raw)):
        n = Counter(raw[i : i + 64].tolist())
        entropy = -sum(c / 64 * math.log2(c / 64) for c in n.values())
        assert abs(level - entropy / 6 * 1000) <= 1.01


def test_fingerprints_follow_the_order(spark):
    rng = random.Random(1)
    texts = {i: "".join(rng.choice("abcdefgh ijklm\nnopé") for _ in range(rng.choice((0, 5, 63, 64, 500, 9000)))) for i in range(40)}
    rows = [*texts.items(), (100, None), (101, texts[7]), (None, "no id at all"), (3, texts[3])]
    got = digest.fingerprints(spark.createDataFrame(rows, DOCS).withColumn("part", F.lit("clash"))).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted((i if i is not None else -1, hashlib.sha256(digest.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["edited_sha256"]) for r in got) == want
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[101]["fingerprint"] == by_id[7]["fingerprint"]
    assert all(0 <= r[k] <= 1 for r in got for k in ("near_edited", "near_next"))
    assert by_id[3]["n_chars"] == len(texts[3])
    ranks = digest.rarity({})
    one, two = digest.fingerprint_texts([order[0][1], "x" * 10], ranks)
    assert digest.likeness(one, one) == 1.0 and digest.likeness(two, two) == 1.0
    assert digest.fingerprints(spark.createDataFrame([(1, "alone")], DOCS)).first()["near_next"] == 1.0
    assert digest.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprints_tell_edits_from_strangers(spark, sf_dir):
    got = digest.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("n_chars > 1500")
    near, far = got.agg(F.avg("near_edited"), F.expr("percentile(near_next, 0.5)")).first()
    assert near > 0.3 and far < 0.15


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 40 and right / n > 0.95


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (77, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, ""), (3, "x " * 50_000)], DOCS).withColumn("score", F.lit("clash"))
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(docs, labels.limit(0)).first()["score"] == 0.5
    assert quality.classify(docs.limit(0), labels).count() == 0


def call(i, name="search", needs=(), **arguments):
    return {"id": i, "name": name, "arguments": arguments} | ({"depends_on": list(needs)} if needs else {})


def test_chat_links_orders_and_validates(spark):
    rows = [
        (1, 0, "user", 'say "hi"'),
        (1, 1, "assistant", json.dumps({"tool_calls": [call("b", needs=["a"], query="x"), call("a", query="y", limit=2)]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": [2]}})), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "ok"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "a", "content": "again"})), (1, 5, "tool", json.dumps({"tool_call_id": "q", "content": 1})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("a", bad=1)]})), (2, 1, "assistant", json.dumps({"tool_calls": [call("c", needs=["d"], query="x"), call("d", needs=["c"], query="x")]})),
        (2, 2, "assistant", json.dumps({"tool_calls": [call("e", query="x")]})), (2, 3, "assistant", "{not json"), (2, 4, None, None), (None, 0, "user", ""), (3, 0, "user", "w " * 50_000),
        (4, 0, "assistant", json.dumps({"tool_calls": [call("a", query="x")]})), (4, 1, "assistant", json.dumps({"tool_calls": [call("a", query="x")]})), (4, 2, "tool", json.dumps({"tool_call_id": "a"})),
    ]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_chats(docs).collect()}
    assert len(got) == len(rows)
    status = {k: r["status"] for k, r in got.items()}
    assert [status[1, t] for t in range(6)] == ["message", "linked", "linked", "linked", "repeated", "orphan"]
    assert [status[2, t] for t in range(5)] == ["invalid", "unordered", "unanswered", "message", "message"]
    assert [status[4, t] for t in range(3)] == ["linked", "repeated_call", "linked"]
    key = lambda t: (got[1, t]["anchor_turn"], got[1, t]["level"], got[1, t]["call_index"], t)
    assert sorted(range(6), key=key) == [0, 1, 3, 4, 2, 5]
    assert got[2, 0]["errors"] == ["a: /query: missing", "a: /bad: unknown"]
    assert got[1, 2]["json"] == '{"content":{"a":[2],"z":1},"role":"tool","tool_call_id":"b"}'
    assert json.loads(got[1, 0]["json"]) == {"content": 'say "hi"', "role": "user"} and got[2, 4]["json"] == '{"content":null,"role":null}'
    assert chat.format_chats(docs.limit(0)).count() == 0


def test_chat_reads_calls_after_any_json_blank(spark):
    blanks = ["", " ", "\n", "\t", "\r\n", " \t\n"]
    rows = [(k, n, role, b + json.dumps(said)) for k, b in enumerate(blanks) for n, (role, said) in enumerate([("assistant", {"tool_calls": [call("a", query="x")]}), ("tool", {"tool_call_id": "a", "content": "ok"})])]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [r["status"] for r in got] == ["linked"] * len(rows)
    bad = spark.createDataFrame([(1, 0, "assistant", "\n" + json.dumps({"tool_calls": [call("a", bad=1)]}))], "conv_id long, turn long, role string, text string")
    assert [r["status"] for r in chat.format_chats(bad).collect()] == ["invalid"]


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(8)
    for _ in range(30):
        supply = [rng.randint(0, 500) for _ in range(rng.randint(1, 9))]
        capacity = reshard.equal_capacities(sum(supply), rng.randint(1, 9))
        flow = reshard.min_cost_flow(supply, capacity)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(len(supply))] == supply
        assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(len(capacity))] == capacity
        assert sum(v for (i, j), v in flow.items() if i != j) == sum(supply) - sum(min(s, c) for s, c in zip(supply, capacity, strict=False))


@pytest.mark.parametrize("files", [False, True])
def test_shards_are_near_equal_and_gapless(spark, files):
    rng = random.Random(4)
    rows = [(i, "é" * rng.randint(0, 400)) for i in range(700)] + [(None, None), (5, "same"), (5, "same"), (9, "x" * 3000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit("clash"))
    old = F.when(F.coalesce(F.col("doc_id"), F.lit(0)) % 3 > 0, 0).otherwise(F.col("doc_id") % 5 + 1)
    got = reshard.reshard(docs, F.coalesce(old, F.lit(1)), 6, 8, out=scratch(spark, "shards") if files else None).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1) for i, t in rows), key=str)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    largest = max(r["size"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 4 * largest
    for k in sizes:
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    moved = sum(r["size"] for r in got if r["shard"] != r["old_shard"])
    supply = Counter()
    for r in got:
        supply[r["old_shard"]] += r["size"]
    cap = reshard.equal_capacities(sum(supply.values()), 8)
    assert moved <= sum(supply.values()) - sum(min(supply[k], cap[k]) for k in range(6)) + 16 * largest
    assert reshard.reshard(docs.limit(0), F.lit(0), 1, 4).count() == 0


def test_archives_round_trip(spark):
    odd = "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n\r\n"
    rows = [(1, "http://a", "<p>é</p>"), (2, None, None), (3, "u", "<p>é</p>"), (4, "u\r\nx", ""), (5, "u", odd), (6, "u", "x" * 200_000), (7, "v", "<p>é</p>"), (8, "w", "lone"), (8, "w", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("clash"))
    path = scratch(spark, "warc")
    index = warc.write(pages, path, roll=100_000)
    got = warc.read(index, path, gap=10).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", 0), i)
    assert len(got) == len(rows)
    html = {i: h or "" for i, _, h in rows}
    for r in got:
        data = html[r["record_id"]].encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = last[html[r["record_id"]]] == r["record_id"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", last[html[r["record_id"]]]))
        assert bytes(r["payload"]) == (data if first else b"")
    some = warc.read(index.where("record_id IN (5, 6)"), path).collect()
    assert {r["record_id"]: bytes(r["payload"]) for r in some} == {5: odd.encode(), 6: b"x" * 200_000}
    assert {r["record_type"] for r in warc.round_trip(pages, scratch(spark, "warc"), min_revisit_bytes=10**6).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0), scratch(spark, "warc")).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == p.COLUMNS, name
        if name != "mixing":
            assert n * 0.5 < out.count() <= n, name
        n, docs = out.count(), out
    last = p.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == n and last.where("NOT decoded").count() == 0
    assert p.STAGES[0][1](spark, docs.limit(0), sf_dir).count() == 0


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    long = "word " * 60_000
    block = "\n".join(f"a line {k} that two documents share" for k in range(4))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", "en", "a", 2), (None, block, "en", "a", 9), (None, None, "en", None, None), (4, block, "en", "a", 9), (4, block, "en", "a", 9), (5, f"{block}\nand one", "en", "b", 9), (6, long, "en", "b", 9), (7, long + "x", None, None, 9)]
    rows += [(10 + k, f"plain words of document {k} in some order of its own {k * 7}", "en", "c", 9) for k in range(20)]
    spark.createDataFrame([(k, k % 2) for k in range(10, 20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, FIELDS)
    for c in ("score", "key", "n_deleted", "component_id", "size", "ids", "task"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = {name: stage(spark, docs, str(tmp_path)) for name, stage in p.STAGES}
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name != p.STAGES[-1][0]:
            assert out[name].columns == p.COLUMNS, name
    said = {name: sorted(((r["doc_id"], r["text"] if "text" in df.columns else r["n_ids"]) for r in df.collect()), key=str) for name, df in out.items()}
    texts = Counter((i, t) for i, t, *_ in rows)
    assert not Counter(said["quality classifier"]) - texts and Counter(said["quality classifier"])[4, block] in (0, 2)
    cut = dict(said["line dedup"])
    assert cut[4] == block and cut[5] == "and one" and None not in [i for i, t in said["line dedup"] if t] and Counter(said["line dedup"])[4, block] == 2
    near = said["n-gram Jaccard join"]
    assert (7, long + "x") in near or (6, long) in near
    assert Counter(near)[4, block] == 1 and (5, f"{block}\nand one") not in near and {(1, None), (2, ""), (3, " \n"), (None, None), (None, block)} <= set(near)
    mixed = Counter(i for i, _ in said["mixing"])
    assert {1, 2, 3} <= set(mixed) and max(n for i, n in mixed.items() if i not in (None, 4)) <= 2
    assert dict(said["sentencepiece"])[1] is None and dict(said["sentencepiece"])[2] == 0 and len(said["sentencepiece"]) == len(rows)


def test_pipeline_removes_what_it_made(spark, sf_dir):
    import corpus_pipeline as p
    from factweave.functions.shared import made, sweep

    sweep(spark)
    assert p.run(spark, sf_dir).where("NOT decoded").count() == 0
    left = made()
    assert sum("mixing-" in x for x in left) == 1 and not any(k in x for x in left for k in ("quality", "blocks", "signatures", "classes", "line-dedup"))
    sweep(spark)
    assert not made()
