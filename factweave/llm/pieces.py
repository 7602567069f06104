"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

Ordinary documents go to the library whole. A giant document is cut into chunks at arbitrary places.

A pair-merging model has no path scores to add up, but its result is still a path: the encoding of a text
is the one sequence of pieces in which each two neighbours, encoded by themselves, stay these two pieces.
So in the lattice of pieces an edge weighs 0 if its pieces are compatible neighbours and minus infinity if not, and the
encoding is the only path of weight 0. That is what the scan works on:

1. A boundary state is the last piece that ends at or before a cut. Each chunk yields its transfer matrix
   from the states of its left cut to those of its right cut, kept as the pairs of weight 0.
2. Matrices are combined by the max-plus product, which is associative: runs of ``FAN`` neighbours are joined, level
   by level and each run by a task of its own, until one is left; going back down gives the state at every cut.
3. With the states at both ends, every chunk is backtraced by itself.

Defined results: a null text has null ids, an empty text none; characters that the model lacks become
bytes, as in the library; equal texts have equal ids; an empty table gives an empty result; extra columns
are carried, whatever their names, but for those made here (``ids``, ``n_ids``, ``decoded``).
The model file is a parameter and must be at the same path on every executor. A document whose matrices leave no path
or several, as those of a model that isn't pair-merging or that changes the text first may do, goes to the library whole; a
model for which the scan differs from the library on a probe is refused for giants, which then all go to the library.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk, and of a document that is scanned in chunks.
CHUNK, GIANT = 16384, 65536
#: Neighbouring matrices that one task joins.
FAN = 32
#: Pairs of pieces whose fit is remembered, at some 200 bytes each.
KNOWN = 250_000
BLANK = "▁"

State = tuple[int, str]  # where the piece ends, relative to the cut; the piece


class Pieces:
    """Pieces of a model and which of them may be neighbours."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        plain = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        self.ids = {self.lib.id_to_piece(i): i for i in plain}
        self.score = {p: self.lib.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.known: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Merges the best pair, the first of equals, until none is left: for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda k: (self.score.get(parts[k] + parts[k + 1], float("-inf")), -k))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        if (a, b) not in self.known:
            if len(self.known) > KNOWN:
                self.known.clear()
            self.known[a, b] = self.merge(a + b) == [x for x in (a, b) if x]
        return self.known[a, b]

    def ending(self, text: str, end: int) -> Iterator[str]:
        """Pieces that end at ``end``; a single character always is one."""
        yield text[end - 1 : end]
        for n in range(2, min(self.longest, end) + 1):
            if (p := text[end - n : end]) in self.score:
                yield p

    def to_ids(self, pieces: Sequence[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out += [self.lib.piece_to_id(f"<0x{b:02X}>") for b in p.encode()]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def states(p: Pieces, context: str) -> list[State]:
    """Every state at a cut, from the text before it; the empty piece where the whole text begins."""
    own = [(-len(context), "")] if len(context) < p.longest else []
    for back in range(min(p.longest, len(context))):
        own += [(-back, piece) for piece in p.ending(context, len(context) - back) if p.merge(piece) == [piece]]
    return own


def lattice(p: Pieces, context: str, chunk: str, entry: Sequence[State]) -> list[dict[str, int]]:
    """For each place of ``context + chunk``, the pieces that end there and can be reached, with the entries
    that reach them as bits. The first piece after an entry ends inside the chunk."""
    text, cut = context + chunk, len(context)
    found: list[dict[str, int]] = [{} for _ in range(len(text) + 1)]
    for k, (at, piece) in enumerate(entry):
        found[cut + at][piece] = found[cut + at].get(piece, 0) | 1 << k
    for end in range(cut + 1, len(text) + 1):
        here = found[end]
        for piece in p.ending(text, end):
            bits = 0
            for before, reach in found[end - len(piece)].items():
                if p.fits(before, piece):
                    bits |= reach
            if bits:
                here[piece] = bits
    return found


def transfer(p: Pieces, context: str, chunk: str, last: bool) -> list[tuple[State, State]]:
    """Pairs of states at the chunk's cuts between which there is a path of weight 0."""
    entry = states(p, context)
    found = lattice(p, context, chunk, entry)
    n = len(context) + len(chunk)
    out = []
    for end in range(n, max(len(context), n - 1 if last else n - p.longest), -1):
        for piece, bits in found[end].items():
            out += [(s, (end - n, piece)) for k, s in enumerate(entry) if bits >> k & 1]
    if not last and len(chunk) < p.longest:  # a piece may span the whole chunk: its state before stays
        out += [(s, (s[0] - len(chunk), s[1])) for s in entry if s[0] - len(chunk) > -p.longest]
    return out


def product(a: Sequence[tuple[State, State]], b: Sequence[tuple[State, State]]) -> list[tuple[State, State]]:
    """Max-plus product of two matrices over 0 and minus infinity."""
    onward: dict[State, list[State]] = {}
    for s, t in b:
        onward.setdefault(s, []).append(t)
    return list(dict.fromkeys((s, u) for s, t in a for u in onward.get(t, ())))


START: State = (0, "")


def through(matrices: Sequence[Sequence[tuple[State, State]]], enter: State, leave: State) -> list[State] | None:
    """The states at the cuts between neighbouring matrices on the path from ``enter`` to ``leave``, both included; None unless there is one such path."""
    reached = [{enter}]
    for m in matrices:
        reached.append({t for s, t in m if s in reached[-1]})
    out = [leave]
    for k in range(len(matrices) - 1, -1, -1):
        before = {s for s, t in matrices[k] if t == out[-1] and s in reached[k]}
        if len(before) != 1:
            return None
        out.append(before.pop())
    return out[::-1] if leave in reached[-1] else None


def end_of(matrix: Sequence[tuple[State, State]]) -> State | None:
    """Where the whole text's only path ends; None if there is none or several."""
    ends = {t for s, t in matrix if s == START and t[0] == 0}
    return ends.pop() if len(ends) == 1 else None


def joined(matrices: Sequence[Sequence[tuple[State, State]]]) -> list[tuple[State, State]]:
    """The product of neighbours, two by two."""
    row = [list(m) for m in matrices]
    while len(row) > 1:
        row = [product(row[k], row[k + 1]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
    return row[0]


def backtrace(p: Pieces, context: str, chunk: str, entry: State, leave: State) -> list[str]:
    """The pieces after ``entry`` up to ``leave``, which belong to this chunk."""
    found = lattice(p, context, chunk, [entry])
    cut = len(context)
    at, piece = cut + len(chunk) + leave[0], leave[1]
    out: list[str] = []
    while (at - cut, piece) != entry:
        out.append(piece)
        at -= len(piece)
        piece = next(q for q in found[at] if p.fits(q, piece))
    return out[::-1]


def split(text: str, size: int, longest: int) -> Iterator[tuple[int, str, str, bool]]:
    """Number, context, text and whether it is the last, of each chunk."""
    n = max(1, -(-len(text) // size))
    for k in range(n):
        yield k, text[max(0, k * size - 2 * longest) : k * size], text[k * size : (k + 1) * size], k == n - 1


def escaped(text: str) -> str:
    """As the model sees a text: blanks marked, and one before it."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def scan(text: str, path: str = MODEL, size: int = CHUNK) -> list[int]:
    """The whole scan in one process: for tests and for single texts."""
    p = load(path)
    parts = list(split(escaped(text), size, p.longest))
    if not text:
        return []
    matrices = [transfer(p, c, t, last) for _, c, t, last in parts]
    end = end_of(joined(matrices))
    at = through(matrices, START, end) if end else None
    if at is None:
        raise ValueError("not one path")
    return [i for (_, c, t, _), s, u in zip(parts, at, at[1:], strict=False) for i in p.to_ids(backtrace(p, c, t, s, u))]


_IDS = pa.list_(pa.int32())


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column("text").to_pylist()
                ids = [None if t is None else p.lib.encode(t) for t in texts]
                back = [None if x is None else p.lib.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                keep = [c for c in part.schema.names if c not in ("ids", "n_ids", "decoded")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(ids, _IDS), pa.array([None if x is None else len(x) for x in ids], pa.int32()), pa.array(back, pa.bool_())],
                    names=[*keep, "ids", "n_ids", "decoded"],
                )

    return run


_MATRIX = "array<struct<a:int,p:string,b:int,q:string>>"


def _transfers(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            for row in batch.to_pylist():
                pairs = transfer(p, row["context"], row["chunk"], row["last"])
                yield pa.RecordBatch.from_pylist([{"key": row["key"], "k": row["k"], "matrix": [{"a": s[0], "p": s[1], "b": t[0], "q": t[1]} for s, t in pairs]}], _schema_of_matrix())

    return run


def _schema_of_matrix() -> pa.Schema:
    cell = pa.struct([("a", pa.int32()), ("p", pa.string()), ("b", pa.int32()), ("q", pa.string())])
    return pa.schema([("key", pa.string()), ("k", pa.int32()), ("matrix", pa.list_(cell))])


def _matrices(column: Sequence) -> list[list[tuple[State, State]]]:
    return [[((m["a"], m["p"]), (m["b"], m["q"])) for m in x] for x in column]


def _join_run(key, pdf):
    product_ = joined(_matrices(pdf.sort_values("k")["matrix"]))
    return pd.DataFrame({"key": [key[0]], "k": [key[1]], "matrix": [[{"a": s[0], "p": s[1], "b": t[0], "q": t[1]} for s, t in product_]]})


def _open_run(key, pdf):
    """The states at the cuts inside a run, from those at its ends; no rows if they aren't the only ones."""
    pdf = pdf.sort_values("k")
    first = pdf.iloc[0]
    at = through(_matrices(pdf["matrix"]), (int(first["a"]), first["p"]), (int(first["b"]), first["q"]))
    at, ks = at or [], pdf["k"] if at else []
    return pd.DataFrame({"key": key[0], "k": list(ks), "a": [s[0] for s in at[:-1]], "p": [s[1] for s in at[:-1]], "b": [s[0] for s in at[1:]], "q": [s[1] for s in at[1:]]})


_STATES = "key string, k int, a int, p string, b int, q string"


def boundary_states(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """``key, k, a, p, b, q``: the states at both ends of each chunk of ``key, k, matrix``, for texts with one path.

    Matrices are joined up in levels of ``fan``, as many as the longest text needs, and the states walk back down the same levels.
    A matrix has a few dozen cells however long the text below it is, so no task holds more than ``fan`` of them at once.
    """
    run = F.floor(F.col("k") / fan).cast("int")
    rows = [matrices]
    most = matrices.agg(F.max("k")).first()[0] or 0
    while most > 0:
        rows.append(written(rows[-1].groupBy("key", run.alias("run")).applyInPandas(_join_run, f"key string, k int, matrix {_MATRIX}"), "products"))
        most //= fan
    start = F.lit(START[0]).alias("a"), F.lit(START[1]).alias("p")
    ends = F.array_distinct(F.transform(F.filter("matrix", lambda m: (m["a"] == START[0]) & (m["p"] == START[1]) & (m["b"] == 0)), lambda m: F.struct(m["b"].alias("b"), m["q"].alias("q"))))
    at = rows[-1].withColumn("ends", ends).where(F.size("ends") == 1).select("key", "k", *start, F.col("ends")[0]["b"].alias("b"), F.col("ends")[0]["q"].alias("q"))
    for level in reversed(rows[:-1]):
        below = level.withColumn("run", run).join(at.withColumnRenamed("k", "run"), ["key", "run"])
        at = written(below.groupBy("key", "run").applyInPandas(_open_run, _STATES), "states")
    return at


def _backtraces(path: str):
    schema = pa.schema([("key", pa.string()), ("k", pa.int32()), ("part", _IDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            out = [{"key": r["key"], "k": r["k"], "part": p.to_ids(backtrace(p, r["context"], r["chunk"], (r["a"], r["p"]), (r["b"], r["q"])))} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def giant_ids(texts: DataFrame, path: str, chunk: int, fan: int = FAN) -> DataFrame:
    """``key, ids`` of the distinct giant texts ``key, text``, by the scan over their chunks."""
    longest = load(path).longest

    cells = pa.schema([("key", pa.string()), ("k", pa.int32()), ("context", pa.string()), ("chunk", pa.string()), ("last", pa.bool_())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = [{"key": key, "k": k, "context": c, "chunk": t, "last": last} for k, c, t, last in split(escaped(text), chunk, longest)]
                yield pa.RecordBatch.from_pylist(rows, cells)

    parts = written(texts.mapInArrow(tidy(cut), "key string, k int, context string, chunk string, last boolean").repartition("key", "k"), "chunks")
    # Chunks are few bytes and much work: as many tasks as there are shuffle partitions, however small they are.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matrices = written(parts.repartition(tasks, "key", "k").mapInArrow(tidy(_transfers(path)), f"key string, k int, matrix {_MATRIX}"), "matrices")
    at = boundary_states(matrices, fan)
    traced = parts.join(at, ["key", "k"]).repartition(tasks, "key", "k").mapInArrow(tidy(_backtraces(path)), "key string, k int, part array<int>")
    ordered = traced.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "part"))).alias("parts"))
    return ordered.select("key", F.flatten("parts.part").alias("ids"))


def encode(docs: DataFrame, path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``docs`` with ids, n_ids and decoded: whether decoding the ids gives the text again."""
    made = ("ids", "n_ids", "decoded")
    docs = small_batches(docs).select(*[c for c in docs.columns if c not in made])
    big = F.length("text") > giant if scans(path) else F.lit(False)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = f"{fields}, ids array<int>, n_ids int, decoded boolean"
    small = docs.where(~F.coalesce(big, F.lit(False))).mapInArrow(tidy(_whole(path)), schema)
    large = docs.where(big).withColumn("__key", F.sha2("text", 256))
    found = written(giant_ids(large.select(F.col("__key").alias("key"), "text").dropDuplicates(["key"]), path, chunk, fan), "giants")
    joined_ = large.join(found.withColumnRenamed("key", "__found"), F.col("__key") == F.col("__found"), "left")
    decode = decoder(path)
    scanned = joined_.where("__found IS NOT NULL").drop("__key", "__found").withColumn("n_ids", F.size("ids")).withColumn("decoded", decode("ids") == F.col("text"))
    # Texts without one path, of which there should be none.
    rest = joined_.where("__found IS NULL").select(*docs.columns).mapInArrow(tidy(_whole(path)), schema)
    return small.unionByName(scanned.select(*small.columns)).unionByName(rest)


#: Letters, cases, accents, blanks, digits, marks and other scripts, for comparing the scan with the library.
PROBE = "The Quick  brown fóx, jumps over 12,345 lazy dogs.\nÀ bientôt! ｆｕｌｌ ﬁne 漢字かな Привет ½ \t" * 2


@lru_cache(maxsize=2)
def scans(path: str) -> bool:
    """Whether the scan gives what the library gives for a model."""
    try:
        return scan(PROBE, path, 40) == load(path).lib.encode(PROBE)
    except ValueError:
        return False


def decoder(path: str = MODEL):
    """A column function from ids to text."""
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        lib = load(path).lib
        return pd.Series([None if x is None else lib.decode([int(i) for i in x]) for x in ids], dtype=object)

    return decode
