"""Near-duplicate documents by HyperMinHash.

A text becomes its set of 5-word shingles. Each of REGISTERS hash functions keeps the smallest value over the set, compressed to a register of a leading-zero count and mantissa bits. Bands of registers propose pairs; the share of equal registers, corrected for chance collisions of compressed registers, estimates the Jaccard similarity and drops hopeless pairs; the rest are confirmed on the full sets.

Texts with equal sets are one class, and classes are what is compared. In each bucket members meet the smallest one, and links fold into components, so a large group of copies costs a row for each member. What is left are buckets of several components. Their classes are joined on single shingles: the shingles of a set are ordered by how many of these sets hold them, rare ones first, and two sets as similar as asked share one among the first n - ceil(percent * n / 100) + 1 of the larger one and the first n - ceil(2 * percent * n / (100 + percent)) + 1 of the smaller one (prefix filter; exact for every pair, whether its registers share a bucket or not). A shared shingle proposes a pair only if components differ and sizes and places leave room for the overlap that the threshold needs. Shingles that more than PIVOTS classes hold go in rounds of more and more pivots, until every pair of different components has been compared.

Nulls, empty and white-space texts have an empty set and link with nothing. Repeated rows are copies of each other. Rows that share a doc_id but not a text are documents of their own: each row's set decides its row, and a component is named by the smallest doc_id of its rows. A null doc_id keeps its row, with a null component. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.components import components
from webloom.llm.words import SPACED, U, Words, grams, mix, pack, signed, slices, whole
from webloom.session import Workspace, ship

K = 5
REGISTERS = 120
ROWS = 5  #: registers in a band; a pair of similarity .85 shares none of 24 bands with a chance of 8e-7
BANDS = REGISTERS // ROWS
MANTISSA = 10
MARGIN = 0.165  #: five standard errors of the estimate at .85 with 120 registers
PIVOTS = 4  #: pivots of a shingle in the first round; each later one takes 8 times as many, since what has folded by then is not compared

_A = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, REGISTERS, dtype=np.uint64) * U(2) + U(1)
_B = np.random.Generator(np.random.PCG64(12)).integers(0, 2**63, REGISTERS, dtype=np.uint64)
_MINE = np.random.Generator(np.random.PCG64(13)).integers(1, 2**63, ROWS, dtype=np.uint64) * U(2) + U(1)


def shingle_set(words: np.ndarray, k: int = K) -> np.ndarray:
    """Sorted distinct shingles: k words each, the whole sequence if shorter."""
    if len(words) == 0:
        return np.zeros(0, U)
    if len(words) < k:
        return np.array([whole(words)], U)
    return np.unique(grams(words, k))


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, 16 bits each: 6 for the leading zeros of the smallest hash, MANTISSA for the bits after its first one."""
    low = np.full(REGISTERS, 2**64 - 1, U)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, (_A[:, None] * shingles[None, at : at + 2048] + _B[:, None]).min(axis=1))
    exponent = np.frexp((low >> U(11)).astype(np.float64))[1]  # bit length of the upper 53 bits
    zeros = np.minimum(53 - exponent, 42)
    mantissa = (low >> (U(63 - MANTISSA) - zeros.astype(U))) & U(2**MANTISSA - 1)
    return ((zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)).astype("<u2")


def estimate(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity from two register arrays. Unrelated registers agree by chance with probability c (equal exponents 2^-i each, equal mantissas 2^-MANTISSA), so the share s of equal ones is corrected to (s - c) / (1 - c)."""
    c = 2.0**-MANTISSA / 3
    return max(0.0, (float((x == y).mean()) - c) / (1 - c))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, two hashes and registers of each text's set. Rows are (doc_id, hash, text)."""
    for part in slices(batches, "text"):
        words = Words(*pack(part.column(2)), SPACED)
        n, hi, lo, regs = [], [], [], []
        for i in range(part.num_rows):
            s = shingle_set(words.hash[words.first[i] : words.first[i + 1]])
            n.append(len(s))
            hi.append(int(signed(mix(s).sum(keepdims=True))[0]) if len(s) else 0)
            lo.append(int(signed(mix(s * U(0xD6E8FEB86659FD93)).sum(keepdims=True))[0]) if len(s) else 0)
            regs.append(registers(s).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "hash", "n_shingles", "hi", "lo", "regs"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band: its key holds the band's number."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        r = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(ids), BANDS, ROWS).astype(U)
        key = mix((r * _MINE).sum(axis=2) + np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
        yield pa.RecordBatch.from_arrays([pa.array(signed(key.reshape(-1)).copy()), pa.array(np.repeat(ids, BANDS))], names=["key", "node"])


def _hopeful(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (2, 3))
            c = 2.0**-MANTISSA / 3
            est = ((x == y).mean(axis=1) - c) / (1 - c)
            yield batch.select([0, 1]).filter(pa.array(est >= threshold))

    return run


def _confirmed(percent: int):
    def sets(column: pa.Array) -> list[np.ndarray]:
        words = Words(*pack(column), SPACED)
        return [shingle_set(words.hash[words.first[i] : words.first[i + 1]]) for i in range(len(column))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # rows come sorted by b: its set is made once
        for batch in batches:
            for part in slices([batch], "text_a", 2 << 20):
                good = []
                first = sets(part.column(2))
                second = part.column(3)
                ids = part.column(1).to_pylist()
                for i, x in enumerate(first):
                    if last is None or last[0] != ids[i]:
                        last = ids[i], sets(second.slice(i, 1))[0]
                    y = last[1]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        words = Words(*pack(part.column(1)), SPACED)
        sets = [shingle_set(words.hash[words.first[i] : words.first[i + 1]]) for i in range(part.num_rows)]
        n = [len(x) for x in sets]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part.column(0)), n), pa.int64()), pa.array(signed(np.concatenate(sets))), pa.array(np.repeat(n, n), pa.int64())], names=["node", "shingle", "n"])


def _several(members: DataFrame) -> DataFrame:
    """Keys of the groups that hold several components, and how many of their members may be the smaller one of a pair."""
    small = F.count_if("small") if "small" in members.columns else F.count("*")
    return members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), small.alias("size")).where("lo != hi and size > 0").select("key", "size")


def _links(pairs: DataFrame, regs: DataFrame, some: DataFrame, percent: int, ws: Workspace, turn: int) -> DataFrame:
    """Proposed pairs (node, b) that the estimate lets pass and the full sets confirm."""
    pairs = pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
    pairs = pairs.join(regs.select(F.col("node").alias("a"), F.col("regs").alias("ra")), "a").join(regs.select(F.col("node").alias("b"), F.col("regs").alias("rb")), "b")
    pairs = ws.save(pairs.select("a", "b", "ra", "rb").mapInArrow(_hopeful(percent / 100 - MARGIN), "a long, b long"), f"pairs{turn}")
    full = pairs.join(some.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(some.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return ws.save(full.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(percent), "a long, b long"), f"links{turn}")


def _place(nodes: DataFrame, links: DataFrame, ws: Workspace, turn: int) -> DataFrame:
    """id, component of every class."""
    named = components(links, ws, f"cc{turn}")
    return ws.save(nodes.select(F.col("node").alias("id")).join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component")), f"placed{turn}")


def _prefixes(shingles: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """key (a shingle that several sets hold), node, n and at: its place among its set's, rare ones first; the places that the prefix filter needs of the larger set, small: of the smaller one."""
    held = ws.save(shingles.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1"), "held")
    rows = shingles.join(held, "shingle", "left").withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("holders", F.lit(1)), "shingle")) - 1)
    return rows.where(f"at <= n - ceil({percent} * n / 100) and holders is not null").select(F.col("shingle").alias("key"), "node", "n", "at", F.expr(f"at <= n - ceil({2 * percent} * n / {100 + percent})").alias("small"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents are linked if 100 * |A and B| >= percent * |A or B|, and component_id is the smallest id reachable through links."""
    return _rows(docs, percent, id_col, text_col).drop("hash")


def _rows(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"), F.col(text_col).cast("string").alias("text"))
    sketch = ws.save(texts.mapInArrow(_sketches, "doc_id long, hash long, n_shingles long, hi long, lo long, regs binary"), "sketch")
    filled = sketch.where("n_shingles > 0 and doc_id is not null")
    # a class is named by its first hash: its smallest doc_id may name another class too
    classes = ws.save(filled.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "hash")).alias("rep"), F.first("regs").alias("regs")).select(F.col("hi").alias("node"), "rep.doc_id", "rep.hash", "regs"), "classes")
    regs = classes.select("node", "regs")
    banded = regs.mapInArrow(_bands, "key long, node long")
    pivots = ws.save(banded.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("b")).where("size > 1").select("key", "b"), "pivots0")
    members = ws.save(banded.join(pivots, "key"), "members0")
    # the texts of classes that share a bucket, once, by the same plan at every size
    wanted = classes.select("node", "doc_id", "hash").join(members.select("node").distinct(), "node").hint("shuffle_merge")
    some = ws.save(texts.join(wanted, ["doc_id", "hash"]).groupBy("node").agg(F.first("text").alias("text")), "some")
    found = _links(members.where("node != b"), regs, some, percent, ws, 0)
    placed = _place(classes, found, ws, 0)
    stars = placed
    # classes in buckets of several components
    named = ws.save(members.join(placed.withColumnRenamed("id", "node"), "node").select("key", "node", "component"), "named")
    several = ws.save(_several(named).select("key"), "several")
    left = named.join(several, "key").select("node").distinct().hint("shuffle_merge")
    shingles = ws.save(some.join(left, "node").select("node", "text").mapInArrow(_shingles, "node long, shingle long, n long"), "shingles")
    members = ws.save(_prefixes(shingles, percent, ws), "prefixes")
    ws.drop("members0", "pivots0", "named", "several", "shingles", "held")
    turn = 1
    while True:
        members = ws.save(members.join(placed.withColumnRenamed("id", "node"), "node"), f"members{turn}")
        sizes = ws.save(_several(members), f"sizes{turn}")
        members = members.join(sizes, "key")
        if sizes.isEmpty():
            break
        most = PIVOTS * 8 ** (turn - 1)
        salt = F.when(F.col("size") <= most, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(most)))
        first = members.where("small").groupBy("key", salt.alias("salt")).agg(F.min(F.struct("node", "component", "n", "at")).alias("p"))
        pivots = ws.save(first.select("key", F.col("p.node").alias("b"), F.col("p.component").alias("component_b"), F.col("p.n").alias("n_b"), F.col("p.at").alias("at_b")), f"pivots{turn}")
        room = f"{100 + percent} * least(n - at, n_b - at_b) >= {percent} * (n + n_b)"  # what both have left is enough
        able = f"(small and (node > b or size > {most}) or not small and n >= n_b) and component != component_b and 100 * least(n, n_b) >= {percent} * greatest(n, n_b) and {room}"
        found = _links(members.join(pivots, "key").where(able), regs, some, percent, ws, turn)
        if not found.isEmpty():
            placed = stars = _place(classes, found.union(stars.select(F.col("id").alias("a"), F.col("component").alias("b"))), ws, turn)
        met = pivots.select("key", F.col("b").alias("node"), F.lit(True).alias("met"))
        members = ws.save(members.where(f"size > {most}").join(met, ["key", "node"], "left").where("met is null").select("key", "node", "n", "at", "small"), f"rest{turn}")
        ws.drop(f"members{turn}", f"sizes{turn}", f"pivots{turn}", f"rest{turn - 1}", "prefixes")
        turn += 1
    named = classes.select("node", "doc_id").join(placed.withColumnRenamed("id", "node"), "node")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = ws.save(named.join(smallest, "component").select(F.col("node").alias("hi"), "component_id"), "final")
    ws.keep("sketch", "final")  # what the result is read from
    has = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    alone = sketch.where(~has).select("doc_id", "hash", "n_shingles", F.col("doc_id").alias("component_id"))
    out = sketch.where(has).join(final, "hi").select("doc_id", "hash", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("component_id") == F.col("doc_id"))


def kept_documents(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents, with all their columns, that near_duplicates() keeps; of rows that repeat id and text all stay or go. Rows with a null id stay."""
    gone = _rows(docs, percent, "doc_id", "text").where("not kept").select(F.col("doc_id").alias("__gone"), F.col("hash").alias("__hash")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["__gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__hash"]), "left_anti")
