"""Rule ledger and mixing against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from factweave.llm import mixing, rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    ws = WORD.findall(text)
    wins = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    n = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(ws) < 10 or 100 * len(covered) > 20 * len(ws),
    }


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "one", "é " * 40, "a b c d e " * 4, "# | x\n# | x\n\n", "l m n", "x" * 100_000, "w " * 3000 + "end", "A B C D E F G H I J K L"]
    out += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    return out + ["twice"] * 3


def test_ledger_measures_like_python(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in rules.apply_policy(rules.ledger(spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash")))).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        want = measured(t)
        assert {k: got[i][k] for k in want} == want, t
        assert not (got[i]["kept"] and want["base_failed"])


def test_policies_and_ablations_read_the_ledger(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts())]
    led = rules.ledger(spark.createDataFrame(rows, DOCS)).cache()
    bits = [r["failed_bits"] for r in led.collect()]
    mask = rules.POLICIES[3]
    for r in rules.ablations(led, 3).collect():
        assert r["n_failed"] == sum(bool(b & r["bit"]) for b in bits)
        assert r["n_only"] == sum(b & mask == r["bit"] for b in bits)
        assert r["n_kept_without"] == sum(b & mask & ~r["bit"] == 0 for b in bits)
    kept = [rules.apply_policy(led, v).where("kept").count() for v in (1, 2, 3)]
    assert kept == sorted(kept, reverse=True)
    assert rules.apply_policy(rules.ledger(spark.createDataFrame([], DOCS))).count() == 0


def filled(sizes, weights, total, cap):
    """Targets by rounds of clamping."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, left = {}, dict(sizes)
    while left:
        rest = total - sum(fixed.values())
        per = rest / sum(w[s] for s in left)
        over = [s for s in left if per * w[s] >= cap * left[s]]
        if not over:
            return fixed | {s: per * w[s] for s in left}
        for s in over:
            fixed[s] = cap * left.pop(s)
    return fixed


def test_mixing_meets_water_filled_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", rng.choice(["b", "a", "hot", "hot", "hot", None]), 1) for i in range(600)]
    rows += [(1000, None, "en", "a", 1), (1001, "", "en", "b", 1), *[(1002, "same row", "en", "a", 1)] * 2, (1003, "x " * 30_000, "en", "é", 1)]
    got = mixing.draw(spark.createDataFrame(rows, DOCS), F.col("doc_id"), carry=["doc_id"]).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = filled(sizes, (5, 2, 1), 1.5 * sum(sizes.values()), 2)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 1
    again = mixing.draw(spark.createDataFrame(rows, DOCS).repartition(7), F.col("doc_id"), carry=["doc_id"]).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mix_is_made_of_whole_and_cut_documents(spark):
    rows = [(i, f"\t w{i} b  c\nd e ", "en", "s" if i % 3 else "t", 1) for i in range(40)]
    drawn = mixing.draw(spark.createDataFrame(rows, DOCS), F.col("doc_id"), carry=["doc_id", "text"]).cache()
    made = mixing.materialise(drawn, ["doc_id", "text"]).collect()
    taken, whole = Counter(), {i: t for i, t, *_ in rows}
    for r in made:
        taken[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert whole[r["doc_id"]].startswith(r["text"])
    assert {r["doc_id"]: r["taken"] for r in drawn.collect() if r["taken"]} == dict(taken)
    assert mixing.draw(spark.createDataFrame([], DOCS), F.col("doc_id"), carry=["doc_id"]).count() == 0
