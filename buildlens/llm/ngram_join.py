"""Jaccard join of documents on word 5-grams, with Bayesian pruning of MinHash candidates.

Words stand between ASCII white space and are compared in lower case. A text of fewer than five words has its words as
one gram; a text without words has none and meets nothing. Copies of a text are one class from the start, so a large
group of them costs no pairs.

1. Each distinct text gets ``BANDS * ROWS_OF_BAND`` MinHash values. Texts that agree in a band share its bucket. At a
   similarity of 0.8 a pair shares none of the buckets with a chance of 4e-7.
2. The pairs of a bucket compare their values ``STEP`` at a time. With a uniform prior, after m agreements of n the
   similarity has a Beta(m + 1, n - m + 1) posterior; a pair is dropped as soon as P(similarity >= threshold) is below
   ``TOLERANCE``. What survives is only linked, so that a group of thousands gives a forest and not all its pairs.
3. Texts linked in that way, directly or not, are compared pair by pair in the same manner and verified exactly, on the
   sets of 64-bit hashes of their grams. The work on large buckets and groups is dealt out as pairs of chunks.
4. Exact links are counted for each text, and components of the exact links are the classes.

No pair leaves a task: tasks give counts of links and forests. Null texts count as empty. Rows with null or repeated ids
are kept; texts are told apart by their md5. Extra columns are not read by ``classes`` and are kept by ``deduplicated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import gram_hashes, in_arrow, mixed, slices, stored, table, text_of, whole_groups, word_hashes, words_of
from buildlens.llm.components import components

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS_OF_BAND, STEP = 28, 4, 16
HASHES = BANDS * ROWS_OF_BAND
#: Rows of a chunk on average; columns of a tile when sets are intersected; pairs that are compared at a time.
CHUNK_ROWS, TILE, PAIRS = 256, 8192, 1 << 18


def text_key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, with repeats, and where each text's hashes start."""
    codes, starts, distinct = words_of(pc.utf8_lower(texts))
    hashes = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    grams, at = gram_hashes(hashes, starts, words)
    sizes = np.diff(starts)
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(words - 1):  # a hash of the words in order and of how many there are
            there = sizes[short] > i
            whole[there] = mixed(whole[there] * np.uint64(31) + hashes[starts[short[there]] + i] + sizes[short[there]].astype(np.uint64))
        grams = np.insert(grams, at[short], whole)
        at = at + np.concatenate(([0], np.cumsum((sizes > 0) & (sizes < words))))
    return grams, at


def signed(docs: DataFrame) -> DataFrame:
    """(node, doc_id, sig) of every row: ``HASHES`` 16-bit MinHash values, null without grams."""
    rng = np.random.default_rng(5)
    odd = rng.integers(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            grams, at = shingles(text_of(batch))
            some = np.flatnonzero(np.diff(at) > 0)
            sig = np.zeros((len(some), HASHES), np.uint32)
            low = (grams >> np.uint64(32)).astype(np.uint32)
            for k in range(HASHES if len(some) else 0):
                sig[:, k] = np.minimum.reduceat(low * odd[k] + add[k], at[some])
            sig = ((sig ^ (sig >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
            out: list[bytes | None] = [None] * batch.num_rows
            for row, one in zip(some.tolist(), sig.astype("<u2")):
                out[row] = one.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["node", "doc_id", "sig"])

    rows = docs.select(text_key().alias("node"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, sign, "node binary, doc_id long, sig binary")


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES) -> list[int]:
    """Fewest agreements of n values with which P(similarity >= threshold) reaches the tolerance, for n = 0, 1, ...

    The posterior tail of Beta(m + 1, n - m + 1) at t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(hashes + 1):
        tail, m = 0.0, -1
        while m < n and tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


NEEDED = needed()


def _pairs(cuts: np.ndarray, chunk: np.ndarray, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of each group; of groups that join two chunks only those across."""
    sizes = np.diff(cuts)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for size in np.unique(sizes[sizes > 1]):
        a, b = np.triu_indices(int(size), 1)
        first = cuts[:-1][sizes == size]
        per = max(1, PAIRS // len(a))
        for k in range(0, len(first), per):
            base = first[k : k + per, None]
            left, right = (base + a).ravel(), (base + b).ravel()
            keep = ~apart[left] | (chunk[left] != chunk[right])
            held.append((left[keep], right[keep]))
            n += len(left)
            if n >= PAIRS:
                yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
                held, n = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])


def surviving(sigs: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the posterior never drops; values are compared ``STEP`` at a time."""
    agree = np.zeros(len(left), np.int32)
    for k in range(0, HASHES, STEP):
        agree += (sigs[left, k : k + STEP] == sigs[right, k : k + STEP]).sum(1, dtype=np.int32)
        keep = agree >= NEEDED[min(k + STEP, HASHES)]
        left, right, agree = left[keep], right[keep], agree[keep]
    return left, right


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row that each row is linked to, directly or not."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _sigs(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sig"].to_pylist()), "<u2").reshape(-1, HASHES)


def _chunks(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return rows["chunk"].to_numpy(), rows["i"].to_numpy() != rows["j"].to_numpy()


def in_chunk_pairs(members: DataFrame, group: str, n: str) -> DataFrame:
    """Rows of each group dealt to chunks by a hash of the node, and copied to each pair of chunks (i <= j) they are in."""
    count = F.greatest(F.lit(1), F.ceil(F.col(n) / CHUNK_ROWS)).cast("int")
    rows = members.withColumn("chunk", F.pmod(F.xxhash64("node"), count).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    rows = rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("other", n)
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "node")


def _candidate_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, cuts in whole_groups(batches, ["bucket", "i", "j"]):
        sigs, nodes = _sigs(rows), rows["node"].to_numpy()
        for left, right in _pairs(cuts, *_chunks(rows)):
            left, right = surviving(sigs, left, right)
            root = _forest(len(nodes), left, right)
            at = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at], pa.binary()), pa.array(nodes[root[at]], pa.binary())], ["a", "b"])


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets of one group."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    row, place = row[shared], np.unique(place[shared], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    common = np.zeros((len(sets), len(sets)))
    for base in range(0, int(place[-1]) + 1 if len(place) else 0, TILE):
        a, b = np.searchsorted(place, [base, base + TILE])
        tile = np.zeros((len(sets), TILE), np.float32)
        tile[row[a:b], place[a:b] - base] = 1
        common += tile @ tile.T
    return common[left, right].astype(np.int64)


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, cuts in whole_groups(batches, ["root", "i", "j"]):
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = rows.slice(a, b - a)
            nodes = part["node"].to_numpy()
            once = np.concatenate(([True], nodes[1:] != nodes[:-1]))  # repeated rows of one id and text
            part, nodes = part.filter(pa.array(once)), nodes[once]
            if len(nodes) < 2:
                continue
            sigs, sets = _sigs(part), [np.frombuffer(x, "<u8") for x in part["grams"].to_pylist()]
            sizes = np.array([len(s) for s in sets])
            links, found = np.zeros(len(nodes), np.int64), []
            for left, right in _pairs(np.array([0, len(nodes)]), *_chunks(part)):
                left, right = surviving(sigs, left, right)
                common = overlaps(sets, left, right)
                # in whole numbers: a / b >= 0.8 as 5a >= 4b
                close = common * 10_000 >= round(THRESHOLD * 10_000) * (sizes[left] + sizes[right] - common)
                left, right = left[close], right[close]
                links += np.bincount(left, minlength=len(nodes)) + np.bincount(right, minlength=len(nodes))
                found.append((left, right))
            root = _forest(len(nodes), *[np.concatenate(x) for x in zip(*found)]) if found else np.arange(len(nodes))
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[at], pa.binary()), pa.array(links[at]), pa.array(nodes[root[at]], pa.binary())], ["node", "links", "linked"]
            )


def _grams(docs: DataFrame) -> DataFrame:
    """``grams`` (sorted distinct 64-bit hashes) in place of ``text``."""
    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["grams binary"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3 << 20):
            flat, at = shingles(text_of(batch))
            sets = [np.unique(flat[a:b]).astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(sets, pa.binary())], [*keep, "grams"])

    return in_arrow(docs, grams, schema)


def text_classes(docs: DataFrame) -> DataFrame:
    """(node, text_id, copies, links, class_id, first) for each distinct text; ``first``: it stands for its class."""
    texts = signed(docs).groupBy("node").agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("copies"), F.first("sig", ignorenulls=True).alias("sig"))
    texts = stored(texts, "texts")
    width = 2 * ROWS_OF_BAND
    bands = texts.filter("sig IS NOT NULL").select(
        "node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * width + 1, F.lit(width))))).alias("bucket")
    )
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = bands.join(shared, "bucket").join(texts.select("node", "sig"), "node")
    forest = in_arrow(in_chunk_pairs(members, "bucket", "n"), _candidate_links, "a binary, b binary")
    groups = stored(components(forest), "groups")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    chosen = groups.join(sizes, "root").join(texts.select("node", "sig", "text_id"), "node")
    # one row of each text is read again: the one with the smallest id
    rows = docs.select(text_key().alias("_node"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    chosen = rows.join(chosen, (F.col("_node") == F.col("node")) & F.col("_id").eqNullSafe(F.col("text_id"))).drop("_node", "_id", "text_id")
    exact = stored(in_arrow(in_chunk_pairs(_grams(chosen), "root", "n"), _exact_links, "node binary, links long, linked binary"), "exact")
    links = exact.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(exact.select(F.col("node").alias("a"), F.col("linked").alias("b")))
    each = texts.drop("sig").join(links, "node", "left").join(roots, "node", "left")
    each = each.select("node", "text_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    lead = each.groupBy("root").agg(F.min(F.struct(F.col("text_id").isNull().alias("none"), "text_id", "node")).alias("lead"))
    each = each.join(lead, "root")
    return each.select("node", "text_id", "copies", "links", F.col("lead.text_id").alias("class_id"), (F.col("lead.node") == F.col("node")).alias("first"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, copies, links, class_id) of every row.

    ``text_id``: smallest id of the equal texts; ``copies``: their number; ``links``: other texts with a similarity of
    the threshold or more; ``class_id``: smallest id of the component.
    """
    info = text_classes(docs).withColumnRenamed("node", "_node").drop("first")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("node"))
    return rows.join(info, F.col("node") == F.col("_node")).select("doc_id", "text_id", "copies", "links", "class_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class, the one with the smallest id, with all its columns."""
    first = text_classes(docs).filter("first").select(F.col("node").alias("_node"), F.col("text_id").alias("_id"))
    kept = docs.join(first, (text_key() == F.col("_node")) & docs["doc_id"].cast("long").eqNullSafe(F.col("_id")), "left_semi")
    twice = docs.groupBy("doc_id", text_key()).count().filter("count > 1").limit(1).count()
    return kept.withColumn("_node", text_key()).dropDuplicates(["doc_id", "_node"]).drop("_node") if twice else kept


def op4_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op4_bayes_jaccard": op4_bayes_jaccard}
SQL = {
    "op4_bayes_jaccard": """
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS text_id, count(*) AS copies FROM documents GROUP BY 1
), words AS (
  SELECT text_id, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM texts
), grams AS (
  SELECT DISTINCT text_id, unnest(CASE WHEN len(w) < 5 THEN CASE WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM words
), sizes AS (SELECT text_id, count(*) AS n FROM grams GROUP BY 1
), common AS (
  SELECT x.text_id AS a, y.text_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.text_id <> y.text_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.text_id = a JOIN sizes q ON q.text_id = b WHERE 5 * c >= 4 * (p.n + q.n - c)
), reach AS (
  SELECT text_id AS node, text_id AS other FROM texts
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
), classes AS (SELECT node, min(other) AS class_id FROM reach GROUP BY 1
), degrees AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT d.doc_id, t.text_id, t.copies, coalesce(g.n, 0) AS links, c.class_id
FROM documents d JOIN texts t ON t.text = coalesce(d.text, '') JOIN classes c ON c.node = t.text_id LEFT JOIN degrees g ON g.a = t.text_id
"""
}
