"""Quality classifier: a regularised quadratic discriminant over statistics of each document.

Statistics are transformed to be roughly symmetric. Each class gets its mean and covariance from
moments that Spark sums over all labelled training rows; only the moments, whose number follows the
number of statistics, reach the driver. Covariances are shrunk towards the pooled one and its scaled
identity. The inverse Cholesky factors are computed once and held in the model, so that a score is the
difference of two Mahalanobis log densities, for a batch of rows at a time.

Defined results: a null or empty text has all counts 0 and is scored like any other; labels that are
null or not 0/1 and labels of unknown documents are not learnt from; of several labels of one document each
counts; equal rows get equal scores; with fewer than two rows of a class the model scores its share of
labels; without labels every score is 0.5; an empty table gives an empty result; other columns,
whatever their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, pieces, small_batches, tidy, utf8, word_spans, written

FEATURES = (
    "log_words", "mean_word", "sd_word", "symbols", "marks", "upper", "distinct", "adjacent", "lone", "line_words", "dup_lines", "digits",
)
FOLDS, FOLD = 5, 0
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    prior: tuple[float, float]
    means: tuple[tuple[float, ...], ...] = ()
    factors: tuple[tuple[tuple[float, ...], ...], ...] = ()
    log_dets: tuple[float, ...] = ()


def _table(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars.encode())] = True
    return found


_SYMBOLS, _MARKS, _DIGITS, _LONE = (_table(c) for c in ("#*$%&|<>@^~=_{}[]\\", "!?;:", "0123456789", "#*$%&|<>@^~=_-.,"))
_BLANK = WS_CHARS.encode()


def measure(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each document of a run, a column each in the order of ``FEATURES``.

    Letters are told by their bytes: ASCII and the Latin-1 supplement have cases, other scripts don't.
    """
    n_docs = len(offsets) - 1
    hashes, at, starts, ends = word_spans(raw, offsets)
    run = lambda flags: np.r_[0, np.cumsum(flags, dtype=np.int64)]
    by_doc = lambda total: total[offsets[1:]] - total[offsets[:-1]]
    by_word = lambda total: total[ends] - total[starts]
    of_words = lambda flags: (lambda t: t[at[1:]] - t[at[:-1]])(run(flags))
    first = (raw & 0xC0) != 0x80
    latin = np.r_[False, raw[:-1] == 0xC3] if len(raw) else first
    lower = ((raw >= 97) & (raw <= 122)) | (latin & (raw >= 0x9F) & (raw <= 0xBF))
    upper = ((raw >= 65) & (raw <= 90)) | (latin & (raw >= 0x80) & (raw <= 0x9E))
    chars = run(first)
    n, length, text_length = np.diff(at).astype(float), by_word(chars).astype(float), by_doc(chars).astype(float)
    shout = (by_word(run(upper)) > 0) & (by_word(run(lower)) == 0)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[at[:-1][at[:-1] < len(hashes)]] = False
    share = lambda part, whole: np.sqrt(np.maximum(part, 0) / np.maximum(whole, 1))
    mean = of_words(length) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(of_words(length * length) / np.maximum(n, 1) - mean * mean, 0))
    different, lines, different_lines = np.zeros(n_docs), np.zeros(n_docs), np.zeros(n_docs)
    data = raw.tobytes()
    for k in range(n_docs):
        different[k] = len(np.unique(hashes[at[k] : at[k + 1]]))
        rows = [x for x in data[offsets[k] : offsets[k + 1]].split(b"\n") if x.strip(_BLANK)]
        lines[k], different_lines[k] = len(rows), len(set(rows))
    return np.column_stack([
        np.log1p(n), np.log1p(mean), spread, share(by_doc(run(_SYMBOLS[raw])), text_length), share(by_doc(run(_MARKS[raw])), text_length), share(of_words(shout), n), share(n - different, n),
        share(of_words(again) - 1.0, n),  # one repetition happens to anyone, and says little in a short text
        share(of_words(by_word(run(_LONE[raw])) == ends - starts), n), np.log1p(n / np.maximum(lines, 1)), share(lines - different_lines, lines), share(by_doc(run(_DIGITS[raw])), text_length),
    ])


def statistics(docs: DataFrame, keep: Sequence[str] = (), model: Model | None = None) -> DataFrame:
    """doc_id, the columns of ``keep`` and the transformed statistics of each whole text, or their ``score`` by ``model``."""
    names = list(dict.fromkeys(["doc_id", *keep]))
    made = ["score"] if model else list(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            parts = [measure(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in pieces(offsets)]
            found = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            out = [probabilities(model, found)] if model else found.T
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, out)], names=[*names, *made])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"{c} double" for c in made])
    return small_batches(docs).select(*dict.fromkeys([*names, "text"])).mapInArrow(tidy(run), schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == FOLD


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", shrink: float = 0.1, ridge: float = 0.02) -> Model:
    """Learns from the labelled rows outside the held-out fold: all of them, by one aggregation."""
    train = stats.join(labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("y")), "doc_id").where(~held_out(F.col("doc_id")))
    d = len(FEATURES)
    upper = np.triu_indices(d)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + len(upper[0])))
        for b in batches:
            x, y = np.column_stack([b.column(f).to_numpy() for f in FEATURES]), b.column("y").to_numpy()
            for k in (0, 1):
                mine = x[y == k]
                total[k] += np.r_[len(mine), mine.sum(axis=0), (mine.T @ mine)[upper]]
        k, i = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"y": k.ravel().astype(np.int32), "i": i.ravel().astype(np.int32), "v": total.ravel()})

    sums = {(r[0], r[1]): r[2] for r in train.select("y", *FEATURES).mapInArrow(moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v")).collect()}  # as many as moments
    found = {y: np.array([sums.get((y, i), 0.0) for i in range(1 + d + len(upper[0]))]) for y in (0, 1)}
    n = np.array([found[y][0] for y in (0, 1)])
    prior = tuple(((n + 1) / (n.sum() + 2)).round(9).tolist())
    if n.min() < 2:
        return Model(prior)
    means, covs = [], []
    for y in (0, 1):
        mu = found[y][1 : 1 + d] / n[y]
        second = np.zeros((d, d))
        second[upper] = second[upper[::-1]] = found[y][1 + d :] / n[y]
        means.append(mu)
        covs.append(second - np.outer(mu, mu))
    pooled = (covs[0] * n[0] + covs[1] * n[1]) / n.sum()
    scale = np.diag(np.maximum(np.diag(pooled), 1e-4))
    factors, dets = [], []
    for c in covs:
        shrunk = (1 - shrink) * c + shrink * pooled + ridge * scale
        lower = np.linalg.cholesky(shrunk.round(10))
        factors.append(np.linalg.inv(lower))
        dets.append(2 * float(np.log(np.diag(lower)).sum()))
    # Rounded, so that the order in which executors' sums arrive cannot show in a score.
    return Model(prior, tuple(tuple(m.round(8).tolist()) for m in means), tuple(tuple(map(tuple, f.round(8).tolist())) for f in factors), tuple(round(x, 8) for x in dets))


def probabilities(model: Model, values: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each row of statistics."""
    if not model.means:
        return np.full(len(values), model.prior[1])
    dens = [
        np.log(model.prior[y]) - model.log_dets[y] / 2 - (((values - np.array(model.means[y])) @ np.array(model.factors[y]).T) ** 2).sum(axis=1) / 2 for y in (0, 1)
    ]
    return (1 / (1 + np.exp(np.clip(dens[0] - dens[1], -500, 500)))).round(12)


def score(model: Model) -> Column:
    """Probability of label 1, from the columns of ``statistics``."""

    @F.pandas_udf("double")
    def probability(x: pd.DataFrame) -> pd.Series:
        return pd.Series(probabilities(model, x.to_numpy(float)))

    return probability(F.struct(*FEATURES))


def score_rows(docs: DataFrame, labels: DataFrame, keep: Sequence[str], sample: int = 50_000) -> DataFrame:
    """The columns of ``keep`` and the score of every row, without storing the texts with their statistics.

    The model is fitted on at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of
    their id; this bound is also what makes the broadcast of their ids safe.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    model = fit(statistics(docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")), chosen)
    # Scored where they are measured: a task with two workers of Python would hold twice the memory.
    return statistics(docs, keep=keep, model=model).select(*keep, "score")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted per document."""
    stats = written(statistics(docs), "quality")
    made = stats.withColumn("score", score(fit(stats, labels)))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
