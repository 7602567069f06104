"""Jaccard join and line dedup against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factweave.llm import jaccard, linededup
from factweave.llm.common import utf8

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=3):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else ({tuple(ws)} if ws else set())


def brute(rows, percent=90, size=3):
    sets = [shingles(t, size) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            (i, _), (j, _) = rows[a], rows[b]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            if i == j or 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), find(i) if i is not None and s else i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def near_copies(seed, n=160):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice((1, 2, 3, 9, 12, 30, 60, 200)))] for _ in range(12)]
    rows = []
    for i in range(n):
        ws = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            k = rng.randrange(len(ws))
            ws[k : k + rng.randint(0, 1)] = [f"x{rng.randint(0, 9)}"]
        sep = rng.choice((" ", "\n", "  "))
        rows.append((i, sep.join(ws).upper() if rng.random() < 0.2 else sep.join(ws)))
    return rows


def run(spark, rows, percent=90, size=3):
    return sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, DOCS).withColumn("rep", F.lit("clash")), percent, size).collect()), key=str)


def test_join_finds_every_link(spark):
    for seed in (1, 2):
        rows = near_copies(seed)
        assert run(spark, rows) == brute(rows)
        assert run(spark, rows, 80, 5) == brute(rows, 80, 5)


def test_join_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 3000)
    monkeypatch.setattr(jaccard, "LEAST", 400)
    rows = near_copies(3)
    assert run(spark, rows) == brute(rows)


def test_join_of_ids_shared_by_texts_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 500)
    monkeypatch.setattr(jaccard, "LEAST", 40)
    rng = random.Random(6)
    ws = lambda n: [f"u{rng.randint(0, 10**6)}" for _ in range(n)]
    long, short = ws(1000), ws(60)
    rows = [(1, " ".join(long)), (1, " ".join(short)), (2, " ".join([*long, "z"])), (3, " ".join([*short, "z"]))]
    rows += [(10 + k, " ".join([*short[:k % 3], *short[1:], f"y{k}"])) for k in range(40)] + [(1, " ".join(ws(60))), (7, " ".join(ws(61)))]
    got = run(spark, rows)
    assert got == brute(rows) and {c for i, _, c in got if i < 50 and i != 7} == {1}


def test_join_of_a_family_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 600)
    monkeypatch.setattr(jaccard, "LEAST", 40)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for k in range(150):  # copies drift, so that ends of the family are linked by others only
        at = rng.randrange(len(base))
        base = [*base[:at], f"x{k}", *base[at + 1 :]]
        rows.append((k, " ".join(base)))
    rows += [(500 + k, " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(100 + k))) for k in range(20)]
    for meet, percent, size in ((2, 90, 3), (1024, 80, 5)):
        monkeypatch.setattr(jaccard, "MEET", meet)
        assert run(spark, rows, percent, size) == brute(rows, percent, size)


def test_longer_vectors_part_blocks_and_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (900, 1500, 1800, 4000, 5200, 5200)]
    sets = sorted((np.unique(np.r_[b[int(len(b) * cut) :], rng.integers(0, 1 << 63, more).astype(np.uint64)]) for b in base for cut in (0, 0.04, 0.09) for more in (0, 30, 200)), key=len)
    sizes, vectors = np.array([len(x) for x in sets]), [jaccard.fine_vector(x) or jaccard._counts(x, jaccard.SKETCH).clip(0, 255).astype(np.uint8).tobytes() for x in sets]
    root = list(range(len(sets)))
    for a, b in jaccard.parted(sizes, vectors, 80, 100):
        root = [root[a] if r == root[b] else r for r in root]
    for a in range(len(sets)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * shared < 80 * (sizes[a] + sizes[b] - shared) or root[a] == root[b]
    assert len(set(root)) >= 6  # of strangers of about one size, too
    monkeypatch.setattr(jaccard, "TILE", 3000)
    monkeypatch.setattr(jaccard, "MEET", 2)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 9000)]
    rows = [(100 * f + k, " ".join([*words[1500 * f + 7 * k : 1500 * f + 1400 + 40 * f], "one common passage at the end of them all that is the same"])) for f in range(5) for k in range(6)]
    for held in (1 << 20, 1):
        monkeypatch.setattr(jaccard, "HELD", held)
        assert run(spark, rows, 80, 5) == brute(rows, 80, 5)


def test_join_ties_classes_of_common_names(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEET", 3)
    rows = near_copies(5)
    assert run(spark, rows) == brute(rows)


def test_join_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "a"), (9, "A"), (10, "a b"), (11, "b a"), (3, "same text here now"), (4, "same text here now"), (4, "another text over there"), (2, "another text over there"), (None, "same text here now"), (12, "long " * 50_000), (13, "long " * 50_001), (3, "same text here now")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(4)
    for n in (10, 40, 300):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        drop = max(1, n // 20)
        sets = [np.unique(a), np.unique(a[drop:]), np.unique(np.r_[a[drop:], rng.integers(0, 1 << 63, 1).astype(np.uint64)])]
        for x in sets:
            for y in sets:
                shared = len(np.intersect1d(x, y))
                for p in (80, 90):
                    if 100 * shared >= p * (len(x) + len(y) - shared) and not np.array_equal(x, y):
                        assert set(jaccard.names(x, p, 100)) & set(jaccard.names(y, p, 100))


def test_shingles_count_like_python():
    texts = ["", "a", "a b", "a b c a b c", "É é x\x0by z", "ünï çødé tèxt wïth wörds"]
    assert [len(s) for s in jaccard.shingle_sets(*utf8(pa.array(texts)), 3)] == [len(shingles(t)) for t in texts]


def every_copy(rows, min_line=3, min_block=10):
    """Every common run with every earlier document, by brute force."""
    count = lambda s: len(WORD.findall(s))
    lines = [[(k, x) for k, x in enumerate(t.split("\n")) if count(x) >= min_line] if t is not None else [] for _, t in rows]
    place = lambda i: (i is None, i or 0)
    out = []
    for (i, t), mine in zip(rows, lines, strict=True):
        gone = set()
        for (j, _), theirs in zip(rows, lines, strict=True):
            if place(j) >= place(i):
                continue
            for a in range(len(mine)):
                for b in range(len(theirs)):
                    n = 0
                    while a + n < len(mine) and b + n < len(theirs) and mine[a + n][1] == theirs[b + n][1]:
                        n += 1
                    if sum(count(x) for _, x in mine[a : a + n]) >= min_block:
                        gone |= {k for k, _ in mine[a : a + n]}
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    return sorted(out, key=str)


def deduped(spark, rows):
    return sorted(((r["doc_id"], r["text"]) for r in linededup.dedup(spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit(1))).collect()), key=str)


def test_line_dedup_meets_every_earlier_document(spark):
    rng = random.Random(11)
    pool = [" ".join(f"v{rng.randint(0, 30)}" for _ in range(rng.randint(1, 9))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    block = [f"short line {k}" for k in range(6)]
    rows += [(100 + k, x) for k, x in enumerate(block)]  # each line has another earliest holder
    rows += [(110, "\n".join(block)), (111, "\n".join([*block, "not of it", *block])), (200, None), (201, ""), (202, "\n\n"), (None, "\n".join(block))]
    hot = "one line that nearly every document of them holds twice"
    rows += [(300 + i, f"own line {i} of it\n{hot}\n{hot}" if i else hot) for i in range(40)]
    got = deduped(spark, rows)
    assert got == every_copy(rows)
    text = dict(got)
    assert text[110] == "\n".join(block) and text[111] == "not of it" and text[None] == "" and text[339] == "own line 39 of it"
    assert linededup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_of_passages_and_repeated_rows(spark):
    passage = "\n".join(f"this is line {k} of a passage that repeats" for k in range(8))
    rows = [(100 + i, f"head {i} of it all\n{passage}\ntail {i} of it all") for i in range(20)]
    rows += [(None, passage), (203, rows[10][1]), (203, rows[10][1])]
    got = deduped(spark, rows)
    assert got == every_copy(rows)
    assert [i for i, t in got if "of a passage" in t] == [100]
    three = "\n".join(f"just four words {k}" for k in range(3))
    rows = [(1, "just four words 0"), (2, three), (3, three)]  # the first line's earliest holder has nothing else
    assert deduped(spark, rows) == [(1, "just four words 0"), (2, three), (3, "")]


def test_line_dedup_salts_hot_lines(spark):
    hot = "one line that nearly every document of them holds twice"
    rows = [(i, "\n".join([f"own line {i} of it", hot, *([hot] if i % 3 else []), f"end {i % 5} of it all"])) for i in range(200)]
    got = deduped(spark, rows)
    assert got == every_copy(rows) and sum(hot in t for _, t in got) == 1


def test_line_dedup_aligns_in_order_first(spark):
    part = lambda c, n=4: [f"{c} line {k} of the block" for k in range(n)]
    a, b, c, d = (part(x) for x in "abcd")
    texts = {1: [*a, "x y z", *b, *c, *d], 2: [*b, "own words of two here", *c, *a], 3: [x for p in (d, c, b, a) for x in p]}
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], DOCS)
    found = [r.asDict() for r in linededup.spans(docs).collect()]
    for s in found:
        i, j = int(s["b"].split(":")[0]), int(s["a"].split(":")[0])
        assert j < i and texts[i][s["b_rank"] - 1 : s["b_rank"] - 1 + s["n"]] == texts[j][s["a_rank"] - 1 : s["a_rank"] - 1 + s["n"]]
        assert [texts[i][k] for k in s["lines"]] == texts[i][s["b_rank"] - 1 : s["b_rank"] - 1 + s["n"]]
    for i, blocks in ((2, 1), (3, 3)):
        mine = [s for s in found if s["b"].startswith(f"{i}:")]
        moved = [s for s in mine if s["moved"]]
        assert len(moved) == blocks and len(mine) - len(moved) == (2 if i == 2 else 1)
    assert [t for _, t in sorted(deduped(spark, [(i, "\n".join(t)) for i, t in texts.items()]))] == ["\n".join(texts[1]), "own words of two here", ""]


def test_op5_query_takes_every_copy(spark, tmp_path):
    from factweave.llm.queries import QUERIES

    rows = [(k, f"short line {k}") for k in range(6)] + [(k, "\n".join(f"short line {n}" for n in range(6))) for k in (10, 11)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()}
    assert got[11] == "" and got[10] == rows[6][1]


def test_patience_keeps_order():
    rows = [(1, 0, True), (2, 1, True), (3, 2, True), (0, 3, True), (9, 4, False), (4, 5, False), (4, 6, False)]
    assert [rows[k][:2] for k in linededup.patience(rows)] == [(1, 0), (2, 1), (3, 2), (4, 5), (4, 6)]
    rng = random.Random(2)
    for _ in range(200):
        rows = [(rng.randint(0, 12), k, rng.random() < 0.5) for k in range(rng.randint(0, 14))]
        runs = [run for _, run in linededup.align(rows)]
        assert sorted(k for run in runs for k in run) == list(range(len(rows)))  # nothing is lost
        assert all([rows[k][0] for k in run] == sorted(rows[k][0] for k in run) and run == sorted(run) for run in runs)
