"""Toxicity by class-conditional Kneser-Ney models.

An expression is a word with its borders: symbols are the bytes of the lower-cased word between two spaces, each predicted from up to ORDER - 1 symbols before it in the word. Two models, toxic and ordinary, count the labelled texts; both discount their counts and back off to one shared model, whose continuation counts come from all documents, so an expression that neither class has seen often scores about 0. A word's score is the difference of the two log-likelihoods, divided by its length in symbols.

A gram is its own key: ORDER bytes in a long, from which context and shorter gram follow by shifts, so nothing is hashed and the counts grow with the corpus. They are counted on every document (tasks pre-aggregate, a shuffle adds up), and the log-likelihood ratio of every gram and context that a labelled text holds is worked out in a table. Scoring takes that table in blocks of at most BLOCK_ROWS rows, cut by context: one narrow pass over the documents for each block, almost always one, adds up each word's ratios.

A document's score is a logistic function of pooled word scores (mean excess and its sum), whose few coefficients are fitted on at most FIT_ROWS labelled rows, those of the smallest hash of their ids. They come from a fifth of the labelled rows, scored with a model that has not counted that fifth; the final model counts all.

Null and empty texts have features 0 and the lowest score. Repeated rows keep a row each; a null doc_id has no label and is not held out; of several labels of an id the highest counts. Other columns are ignored. Without labels every score is below the threshold; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import PLAIN, U, Words, pack, signed, slices
from webloom.session import Workspace, ship

ORDER = 8  #: symbols in a gram
DISCOUNT = 0.75
PRIOR = 5.0  #: a context seen H times leaves at least PRIOR / (H + PRIOR) to the shared model
EXCESS = 4.0  #: what a word's log-likelihood ratio must exceed to count
THRESHOLD = 0.7
FIT_ROWS = 20_000
BROADCAST_ROWS = 4_000_000  #: labels of 16 bytes; more of them are joined by a shuffle
BLOCK_ROWS = 6_000_000  #: grams of 12 bytes that are broadcast at once
HELD_ROWS = 250_000  #: distinct grams that a task holds before it passes them on
SLICE = 2 << 20


class Expressions:
    """Distinct words of a piece of text, and the gram that ends at each of their symbols."""

    def __init__(self, words: Words):
        kinds, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        self.inverse = inverse.reshape(-1)
        size = (words.ends - words.starts)[first] + 2
        begin = np.concatenate([[0], np.cumsum(size)])
        total = int(begin[-1])
        self.symbols = size - 1
        stream = np.full(total, 32, np.uint8)
        place = (np.arange(total) - np.repeat(begin[:-1], size)).astype(np.int32)
        inner = np.flatnonzero((place > 0) & (place < np.repeat(size, size) - 1))
        stream[inner] = words.data[np.repeat(words.starts[first] - begin[:-1] - 1, size)[inner] + inner]
        at = np.flatnonzero(place > 0)  # predicted symbols
        n = np.minimum(place[at] + 1, ORDER)
        gram = stream[at].astype(U)
        for j in range(1, ORDER):
            k = np.flatnonzero(n > j)
            gram[k] |= stream[at[k] - j].astype(U) << U(8 * j)
        self.gram, self.context = signed(gram), signed(gram >> U(8))
        self.word = np.repeat(np.arange(len(size), dtype=np.int32), self.symbols)


def _merged(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([g for g, _ in pieces]), return_inverse=True)
    counts = np.concatenate([c for _, c in pieces], axis=1)
    return keys, np.stack([np.bincount(where.reshape(-1), weights=c, minlength=len(keys)).astype(np.int32) if c.any() else np.zeros(len(keys), np.int32) for c in counts])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams with their counts in ordinary and toxic texts, and in those of the calibration part; a gram may come several times from a task."""

    def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), *(pa.array(c[at : at + 100_000]) for c in counts)], names=["gram", "c0", "c1", "c2", "c3"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in slices(batches, "text", SLICE):
        words = Words(*pack(part.column(0)), PLAIN)
        if not len(words.hash):
            continue
        e = Expressions(words)
        keys, where = np.unique(e.gram, return_inverse=True)
        label = np.repeat(np.asarray(part.column(1)), np.diff(words.first))  # -1: none; 0, 1; 2, 3 in the calibration part
        counts = np.zeros((4, len(keys)), np.int32)
        for k in range(4):
            mine = label == k
            if mine.any():
                weight = np.bincount(e.inverse[mine], minlength=len(e.symbols))
                counts[k] = np.bincount(where.reshape(-1), weights=weight[e.word], minlength=len(keys))
        held.append((keys, counts))
        if sum(len(k) for k, _ in held) > 2 * HELD_ROWS:
            held = [_merged(held)]
            if len(held[0][0]) > HELD_ROWS:
                yield from rows(*held.pop())
    if held:
        yield from rows(*_merged(held))


def _without_first(gram: str) -> str:
    """A gram less its first symbol: its symbols are its bytes from the first one that is not 0."""
    cases = " ".join(f"when shiftrightunsigned({gram}, {8 * (n - 1)}) != 0 then {gram} & {(1 << 8 * (n - 1)) - 1}" for n in range(ORDER, 1, -1))
    return f"case {cases} else 0L end"


def ratios(counted: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Two tables, with the log-likelihood ratios of the model without the calibration part (r0) and of the whole one (r1): by gram (key, context) and, for grams unseen in both classes, by context."""
    grams = counted.withColumns({"context": F.shiftrightunsigned("gram", 8), "less": F.expr(_without_first("gram"))}).withColumn("less_context", F.shiftrightunsigned("less", 8))
    types = grams.groupBy("less").agg(F.count("*").alias("types"))
    kinds = grams.groupBy("less_context").agg(F.count("*").alias("kinds"))
    mine = grams.where("c0 + c1 + c2 + c3 > 0")
    mine = mine.select("gram", "context", "less", "less_context", F.col("c0").alias("o0"), F.col("c1").alias("t0"), (F.col("c0") + F.col("c2")).alias("o1"), (F.col("c1") + F.col("c3")).alias("t1"))
    names = ("o0", "t0", "o1", "t1")
    seen = mine.groupBy("context").agg(*[F.sum(c).alias(f"h_{c}") for c in names], *[F.count_if(F.col(c) > 0).alias(f"k_{c}") for c in names])

    def weight(c: str) -> Column:
        h = F.col(f"h_{c}")
        return F.when(h > 0, F.least(F.lit(1.0), F.greatest(DISCOUNT * F.col(f"k_{c}") / h, PRIOR / (h + PRIOR)))).otherwise(1.0)

    seen = ws.save(seen.select("context", *[F.col(f"h_{c}") for c in names], *[weight(c).alias(f"w_{c}") for c in names]), "contexts")
    full = mine.join(types, "less").join(kinds, "less_context").join(seen, "context")
    shared = 0.95 * F.col("types") / F.col("kinds") + 0.05 / 256

    def log(c: str) -> Column:
        own = F.when(F.col(f"h_{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"h_{c}")).otherwise(0.0)
        return F.log(own + F.col(f"w_{c}") * shared)

    by_gram = full.select(F.col("gram").alias("key"), "context", *[F.when(F.col(f"o{k}") + F.col(f"t{k}") > 0, log(f"t{k}") - log(f"o{k}")).cast("float").alias(f"r{k}") for k in (0, 1)])
    by_context = seen.select("context", *[(F.log(f"w_t{k}") - F.log(f"w_o{k}")).cast("float").alias(f"r{k}") for k in (0, 1)])
    return ws.save(by_gram, "by_gram"), by_context


class Block:
    """Sorted keys and ratios of the grams and contexts whose context is number k of n, modulo n."""

    def __init__(self, by_gram: DataFrame, by_context: DataFrame, name: str, k: int, n: int):
        self.k, self.n = k, n
        here = F.pmod("context", F.lit(n)) == k
        self.grams = self._sorted(by_gram.where(here & F.col(name).isNotNull()).select("key", name))
        self.contexts = self._sorted(by_context.where(here).select("context", name))

    @staticmethod
    def _sorted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = rows.toArrow()  # at most about BLOCK_ROWS rows of 12 bytes
        key, value = (table.column(c).to_numpy() for c in (0, 1))
        order = np.argsort(key)
        return key[order], value[order].astype(np.float32)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(x), np.float32), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return values[at], keys[at] == x

    def scores(self, e: Expressions) -> np.ndarray:
        """What the block's grams add to each word of the text."""
        ratio, seen = self._find(self.grams, e.gram)
        rest, known = self._find(self.contexts, e.context)
        ratio = np.where(seen, ratio, np.where(known, rest, np.float32(0)))
        if self.n > 1:
            ratio[e.context % self.n != self.k] = 0
        return np.bincount(e.word, weights=ratio, minlength=len(e.symbols))[e.inverse]


def pooled(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text: log of its mean excess, and log of one more than its sum."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    excess = np.bincount(doc, weights=np.maximum(scores - EXCESS, 0), minlength=len(n))
    return np.stack([np.log(excess / np.maximum(n, 1) + 1e-3) - np.log(1e-3), np.log1p(excess)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a logistic regression, the constant last; by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    if len(y) == 0:
        return np.array([1.0] * x.shape[1] + [-6.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _partial(block):
    """Adds a block's share to the word scores that ride along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            words = Words(*pack(part.column(0)), PLAIN)
            s = _summed(block.value, words, part.column(2))
            cut = [s[a:b].astype("<f4").tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cut, pa.binary())], names=["text", "row", "sums"])

    return run


def _summed(block: Block, words: Words, before: pa.Array) -> np.ndarray:
    s = block.scores(Expressions(words)) if len(words.hash) else np.zeros(0)
    return s + np.frombuffer(b"".join(x for x in before.to_pylist()), "<f4") if before.null_count < len(before) else s


def _scored(block, weights: np.ndarray | None):
    """Gives each row its features, or its score if weights are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            words = Words(*pack(part.column(0)), PLAIN)
            x = pooled(_summed(block.value, words, part.column(2)), words.first)
            if weights is None:
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["row", "x0", "x1"])
            else:
                p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(p)], names=["row", "score"])

    return run


class Model:
    """Ratio tables and coefficients; name says which column of ratios counts."""

    def __init__(self, by_gram: DataFrame, by_context: DataFrame, name: str, block_rows: int = BLOCK_ROWS):
        self.by_gram, self.by_context, self.name = by_gram, by_context, name
        self.blocks = -(-max(by_gram.count(), by_context.count()) // block_rows) or 1

    def apply(self, rows: DataFrame, weights: np.ndarray | None) -> DataFrame:
        """From (text, row): row and its features, or its score."""
        spark = rows.sparkSession
        rows = rows.select("text", "row", F.lit(None).cast("binary").alias("sums"))
        kind = rows.schema["row"].dataType.simpleString()
        for k in range(self.blocks):
            block = spark.sparkContext.broadcast(Block(self.by_gram, self.by_context, self.name, k, self.blocks))
            if k < self.blocks - 1:
                rows = rows.mapInArrow(_partial(block), rows.schema)
        return rows.mapInArrow(_scored(block, weights), f"row {kind}, x0 double, x1 double" if weights is None else f"row {kind}, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[Model, np.ndarray]:
    """The model and the coefficients, learned from labelled rows that are not held out. Counts: all of them, and for backoff every document."""
    spark = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "toxic")
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(15)) >= 12  # a fifth, for the coefficients
    known = ws.save(known.select("doc_id", (F.when(F.col("toxic") == 1, 1).otherwise(0) + F.when(part, 2).otherwise(0)).cast("int").alias("label")), "labels")
    few = known.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id", "left")
    rows = texts.select("text", F.coalesce("label", F.lit(-1)).alias("label")).mapInArrow(_count, "gram long, c0 int, c1 int, c2 int, c3 int")
    counted = ws.save(rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "c2", "c3")]), "counted")
    tables = ratios(counted, ws)
    ws.drop("counted")
    chosen = known.where("label >= 2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    mine = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").alias("row"))
    got = Model(*tables, "r0", block_rows).apply(mine, None).toArrow()
    ws.drop("labels")
    x = np.stack([got.column(k).to_numpy() for k in (1, 2)], axis=1)
    return Model(*tables, "r1", block_rows), fit(x, got.column(0).to_numpy() - 2)


def score(docs: DataFrame, model: Model, weights: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """row (the id column) and score of every document: a narrow pass."""
    return model.apply(docs.select("text", F.col(id_col).alias("row")), weights)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, *train(docs, labels))
    return out.select(F.col("row").alias("doc_id"), held_out(F.col("row")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic."""
    model, weights = train(docs, labels)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "text")
    return score(whole, model, weights, "whole").where(F.col("score") < threshold).select("row.*")
