"""Twins in plain Python, written from the definitions and without the library's code, of operators that SQL cannot express."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import chat, digest, pieces, quality, reshard, warc
from factweave.llm.common import scratch

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
M64 = (1 << 64) - 1


# The quadratic discriminant.


def described(text):
    """The statistics of a text of ASCII and Latin-1 letters, in the order of the model."""
    text = text or ""
    ws = WORD.findall(text)
    n, chars = len(ws), len(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws]
    up = lambda w: bool(re.search("[A-ZÀ-Þ]", w)) and not re.search("[a-zß-ÿ]", w)
    share = lambda part, whole: math.sqrt(max(part, 0) / max(whole, 1))
    mean = sum(map(len, ws)) / max(n, 1)
    spread = math.sqrt(max(sum(len(w) ** 2 for w in ws) / max(n, 1) - mean * mean, 0))
    of = lambda marks: sum(c in marks for c in text)
    return [
        math.log1p(n), math.log1p(mean), spread, share(of("#*$%&|<>@^~=_{}[]\\"), chars), share(of("!?;:"), chars), share(sum(map(up, ws)), n), share(n - len(set(low)), n),
        share(sum(a == b for a, b in zip(low, low[1:])) - 1, n), share(sum(all(c in "#*$%&|<>@^~=_-.," for c in w) for w in ws), n), math.log1p(n / max(len(lines), 1)),
        share(len(lines) - len(set(lines)), len(lines)), share(of("0123456789"), chars),
    ]


def discriminant(rows, labels, shrink=0.1, ridge=0.02):
    """Scores by means, covariances and their inverses, without moments, factors or Spark."""
    out_of_fold = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    x = {i: np.array(described(t)) for i, t in rows}
    by = [np.array([x[i] for i, y in labels if y == k and i in x and out_of_fold(i)]) for k in (0, 1)]
    covs = [np.cov(b.T, bias=True) for b in by]
    n = [len(b) for b in by]
    pooled = (covs[0] * n[0] + covs[1] * n[1]) / sum(n)
    scale = np.diag(np.maximum(np.diag(pooled), 1e-4))
    logs = []
    for k in (0, 1):
        c = (1 - shrink) * covs[k] + shrink * pooled + ridge * scale
        inverse, (_, det) = np.linalg.inv(c), np.linalg.slogdet(c)
        mu = by[k].mean(axis=0)
        logs.append({i: math.log((n[k] + 1) / (sum(n) + 2)) - det / 2 - (v - mu) @ inverse @ (v - mu) / 2 for i, v in x.items()})
    return {i: 1 / (1 + math.exp(min(max(logs[0][i] - logs[1][i], -500), 500))) for i in x}


def test_scores_are_those_of_a_plain_discriminant(spark):
    rng = random.Random(12)
    good = ["the", "river", "Été", "walks", "slowly", "über", "and", "we", "saw", "stones.", "Why?", "In", "1994"]
    bad = ["###", "BUY", "$$$", "now!!!", "x=1", "|", "CLICK", "0000", "the", "a_b", "ÀÉ"]
    rows = []
    for i in range(240):
        words = [rng.choice(good if i % 2 else bad if rng.random() < 0.7 else good) for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", "\t "]) for w in words)))
    rows += [(900, None), (901, ""), (902, " \n")]
    labels = [(i, i % 2) for i in range(200)] + [(5000, 1)]
    got = {r["doc_id"]: r for r in quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    want = discriminant(rows, labels)
    assert max(abs(got[i]["score"] - want[i]) for i in want) < 1e-6
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == (got[i]["score"] >= 0.3) for i in want)
    both = quality.score_rows(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"), keep=["doc_id"]).collect()
    assert max(abs(r["score"] - want[r["doc_id"]]) for r in both) < 1e-6  # the pipeline's path


# Tool calls.


def linked(rows, schemas):
    """anchor, level, call index and status of every message, by loops over one conversation at a time."""
    def said(role, text):
        try:
            x = json.loads(text) if text is not None and role in ("assistant", "tool") else None
        except ValueError:
            return None, None
        if isinstance(x, dict) and role == "tool" and isinstance(x.get("tool_call_id"), str):
            return None, x["tool_call_id"]
        if isinstance(x, dict) and role == "assistant" and isinstance(x.get("tool_calls"), list) and x["tool_calls"]:
            return x["tool_calls"], None
        return None, None

    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == conv)
        calls, first = {}, {}
        for _, turn, role, text in mine:
            made, result = said(role, text)
            for k, c in enumerate(made or []):
                calls.setdefault(c["id"], (turn, k, set(c.get("depends_on", []))))
            if result is not None:
                first.setdefault(result, turn)
        level = {i: 1 for i, c in calls.items() if not c[2]}
        while True:
            more = {i: 1 + max(level[x] for x in c[2]) for i, c in calls.items() if i not in level and all(x in level for x in c[2])}
            if not more:
                break
            level |= more
        for _, turn, role, text in mine:
            made, result = said(role, text)
            if result is not None:
                t, k, _ = calls.get(result, (turn, 0, None))
                status = "orphan" if result not in calls else "repeated" if turn > first[result] else "linked"
                out[conv, turn] = (t, level.get(result, -1) if result in calls else 0, k, status)
            elif made:
                wrong = any(set(c["arguments"]) != {"query"} or not isinstance(c["arguments"]["query"], str) for c in made)
                again = any(calls[c["id"]][0] < turn for c in made)
                status = "invalid" if wrong else "repeated_call" if again else "unordered" if any(c["id"] not in level for c in made) else "unanswered" if any(c["id"] not in first for c in made) else "linked"
                out[conv, turn] = (turn, 0, 0, status)
            else:
                out[conv, turn] = (turn, 0, 0, "message")
    return out


@pytest.mark.parametrize("held", [20_000, 2])
def test_random_tool_calls_like_loops(spark, monkeypatch, held):
    monkeypatch.setattr(chat, "HELD", held)
    monkeypatch.setattr(chat.levels, "__defaults__", (held,))
    rng = random.Random(21)
    rows = []
    for conv in range(40):
        names = [f"c{k}" for k in range(rng.randint(1, 9))]
        for turn in range(rng.randint(1, 14)):
            what = rng.random()
            if what < 0.4:
                made = []
                for i in rng.sample(names, rng.randint(1, min(3, len(names)))):
                    c = {"id": i, "name": "search", "arguments": rng.choice([{"query": "x"}] * 6 + [{"query": 1}, {"bad": "x"}, {}])}
                    needs = rng.sample([*names, "unknown"], rng.choice([0, 0, 0, 1, 1, 2]) if len(names) > 1 else 0)  # circles included
                    made.append(c | ({"depends_on": needs} if needs else {}))
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": made})))
            elif what < 0.8:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*names, "nobody"]), "content": turn})))
            else:
                rows.append((conv, turn, rng.choice(["user", "assistant", "tool"]), rng.choice(["hello", "{", '{"a": 1}', "[1]", None, ""])))
    got = {(r["conv_id"], r["turn"]): (r["anchor_turn"], r["level"], r["call_index"], r["status"]) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == linked(rows, None)


def test_odd_json_never_stops_a_chat(spark):
    deep = "[" * 100_000 + "]" * 100_000
    calls = lambda **c: json.dumps({"tool_calls": [{"id": "a", "name": "search", **c}]})
    rows = [
        (0, 0, "tool", '{"tool_call_id": "a\\ud800", "content": "\\udfff \\ud83d\\ude00"}'), (1, 0, "assistant", calls(arguments=deep)), (2, 0, "assistant", '{"tool_calls": ' + deep + "}"),
        (3, 0, "tool", '{"tool_call_id": "a", "content": NaN}'), (4, 0, "assistant", calls(arguments='{"query": Infinity}')), (5, 0, "assistant", '{"tool_calls": [{"id": "\\udc00", "name": "none", "arguments": {"\\ud800": 1}}]}'),
        (6, 0, "assistant", '{"tool_calls": [{"id": "a", "name": "listed", "arguments": {"n": null, "m": 2.0, "k": true}}]}'), (7, 0, "assistant", '{"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": 1, "query": "x"}}]}'),
    ]
    schemas = chat.SCHEMAS | {"listed": {"type": ["object", "null"], "properties": {"n": {"type": ["string", "null"]}, "m": {"type": "integer"}, "k": {"enum": [1, "x"]}}}}
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()}
    assert json.loads(got[0]["json"]) == {"role": "tool", "tool_call_id": "a\ud800", "content": "\udfff 😀"}
    assert [got[k]["status"] for k in range(8)] == ["orphan", "invalid", "message", "message", "invalid", "unanswered", "invalid", "unanswered"]
    assert got[6]["errors"] == ["a: /k: not in enum"]
    assert all(json.loads(r["json"], parse_constant=pytest.fail) for r in got.values())


# Shards.


def test_shards_like_a_list_that_is_cut(spark):
    rng = random.Random(5)
    rows = [(i, "é" * rng.randint(0, 60)) for i in range(1500)] + [(None, None), (7, "twice"), (7, "twice")]
    old_of = lambda i: 0 if i is not None and i % 3 else (i or 1) % 4 + 1
    docs = spark.createDataFrame([(i, t, old_of(i)) for i, t in rows], DOCS + ", old int")
    got = reshard.reshard(docs, F.col("old"), 5, 6, out=scratch(spark, "shards")).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["old_shard"]) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode()), old_of(i)) for i, t in rows)
    total = sum(size(t) for _, t in rows)
    supply, capacity = Counter(), [total // 6 + (j < total % 6) for j in range(6)]
    for i, t in rows:
        supply[old_of(i)] += size(t)
    largest = max(size(t) for _, t in rows)
    fewest = sum(max(0, supply[k] - (capacity[k] if k < 6 else 0)) for k in range(5))
    moved = sum(r["size"] for r in got if r["shard"] != r["old_shard"])
    assert abs(moved - fewest) <= 5 * largest  # a row on a cut goes to the side on which it begins
    filled = Counter()
    for r in got:
        filled[r["shard"]] += r["size"]
    assert all(abs(filled[j] - capacity[j]) <= 10 * largest for j in range(6))
    for j in range(6):
        assert sorted(r["slot"] for r in got if r["shard"] == j) == list(range(sum(r["shard"] == j for r in got)))
    assert all(r["shard"] == r["old_shard"] for r in got if supply[r["old_shard"]] <= capacity[r["old_shard"]])


# Fingerprints.


def spread(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def padded(text):
    raw = text.encode()
    return raw + b"\0" * (64 - len(raw)) if 0 < len(raw) < 64 else raw


def entropies(raw):
    fix = 1 << 20
    add = [0, *(round((m * math.log2(m) - (m - 1) * math.log2(max(m - 1, 1))) * fix) for m in range(1, 65))]
    full = round(64 * 6 * fix)
    return [min(1000, max(0, (full - sum(sum(add[1 : c + 1]) for c in Counter(raw[i : i + 64]).values())) * 1000 // full)) for i in range(len(raw) - 63)] if raw else []


def plain_filters(text, rank):
    """Bloom filters of a text, each a set of bits."""
    raw = padded(text)
    found = entropies(raw)
    wins = Counter()
    for i in range(len(found)):
        wins[min(range(i, min(i + 64, len(found))), key=lambda k: (rank[found[k]], k))] += 1
    low = {e for e in range(1001) if rank[e] > 900}
    chosen = [i for i in sorted(wins) if wins[i] >= 16 and found[i] not in low]
    if not chosen and found:
        chosen = [max(range(len(found)), key=lambda k: (wins[k], -k))]
    hashes = []
    for i in chosen:
        h = 0
        for k in range(8):
            h = spread((h + int.from_bytes(raw[i + 8 * k : i + 8 * k + 8], "little")) & M64)
        if h not in hashes:
            hashes.append(h)
    return [{h >> (11 * k) & 2047 for h in hashes[at : at + 160] for k in range(5)} for at in range(0, len(hashes), 160)]


def written_form(filters):
    data = bytearray()
    for bits in filters:
        row = bytearray(256)
        for b in bits:
            row[b // 8] |= 128 >> b % 8
        data += row
    return f"{len(filters)}:" + base64.b64encode(bytes(data)).decode()


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    total = 0.0
    for x in a:
        total += len(x) * max(min(1.0, max(0.0, (len(x & y) - len(x) * len(y) / 2048) / max(min(len(x), len(y)) - len(x) * len(y) / 2048, 1e-9))) for y in b)
    return total / sum(map(len, a))


def test_fingerprints_like_plain_python(spark):
    rng = random.Random(3)
    words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}é" for _ in range(80)]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 120, 1500 if i < 2 else 60]))) for i in range(14)}
    texts |= {20: "a" * 300, 21: "short", 22: texts[3], 23: "", 24: "tail " * 40}
    rows = [*texts.items(), (30, None)]
    got = {r["doc_id"]: r for r in digest.fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    counts = Counter(e for _, t in rows for e in entropies(padded(t or "")))
    rank = {e: k for k, e in enumerate(sorted(range(1001), key=lambda e: (e < 100, counts[e], e)))}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        other = t[: len(t) - half] + following[:half]
        mine, edited, after = (plain_filters(x, rank) for x in (t, other, following))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(other.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (written_form(mine), written_form(edited)), i
        assert abs(r["near_edited"] - plain_likeness(mine, edited)) < 1e-6 and abs(r["near_next"] - plain_likeness(mine, after)) < 1e-6


# The tokenizer's levels, and archives.


def test_matrices_combine_over_several_levels(spark, monkeypatch):
    lib = pieces.load(pieces.MODEL).lib
    rng = random.Random(13)
    texts = ["".join(rng.choice(["the ", "xx", " ", "é", "漢", "\n", "ing", "12"]) for _ in range(n)) for n in (200, 330, 901)]
    docs = spark.createDataFrame([*enumerate(texts)], DOCS)
    got = pieces.encode(docs, giant=100, chunk=61, fan=3).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: lib.encode(t) for i, t in enumerate(texts)} and all(r["decoded"] for r in got)
    monkeypatch.setattr(pieces, "scans", lambda path: False)  # a model that the scan cannot follow
    assert {r["doc_id"]: r["ids"] for r in pieces.encode(docs, giant=100, chunk=61).collect()} == {i: lib.encode(t) for i, t in enumerate(texts)}
    assert pieces.through([[(pieces.START, (0, "a")), (pieces.START, (0, "b"))], [((0, "a"), (0, "c")), ((0, "b"), (0, "c"))]], pieces.START, (0, "c")) is None


def test_a_text_without_one_path_goes_to_the_library(spark, monkeypatch):
    lib = pieces.load(pieces.MODEL).lib
    texts = ["some words here and there " * 20, "other ones " * 30]
    empty = spark.createDataFrame([], "key string, k int, a int, p string, b int, q string")
    monkeypatch.setattr(pieces, "boundary_states", lambda matrices, fan: empty)
    got = pieces.encode(spark.createDataFrame([*enumerate(texts)], DOCS), giant=100, chunk=61).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: lib.encode(t) for i, t in enumerate(texts)}


def test_payloads_are_hashed_again(spark):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "", "two"), (3, "v\r\nw", "one")], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    got = {r["record_id"]: r for r in warc.read(warc.write(pages, path), path).collect()}
    assert [got[k]["intact"] for k in (1, 2, 3)] == [None, True, True] and [got[k]["url"] for k in (1, 2, 3)] == ["u", None, "v%0Aw"]
    false = b"".join(x for x in [warc.record({"record_id": 1, "url": "u", "record_type": "response", "payload_digest": "A" * 32, "payload_bytes": 3, "payload": b"one"})])
    assert warc.parse(false)["intact"] is False
