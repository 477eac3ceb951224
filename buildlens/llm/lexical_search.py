"""Ranked lexical search over hashed max-sketches.

1. One pass counts the documents with terms, all terms, and the documents that hold each term of the items.
2. A second pass folds each text into its sketch: a term's impact (what its occurrences add per unit of its weight)
   goes to one of ``COORDINATES`` places by the term's hash, and each place keeps the largest. Only places that a text
   fills are written. Of texts with equal words, one sketch and the ``k`` smallest document ids are kept.
3. Items look their terms' places up in batches of sketches: weights times maxima add up to an upper bound of the score.
   The ``FIRST`` texts of the largest bounds are scored exactly; the item's k-th best score so far is its threshold.
4. Going down the bounds, every other text whose bound reaches the threshold is scored exactly too; no text below can
   be among the best.

Terms are maximal runs of ASCII letters and digits and of all other characters outside ASCII, A-Z lower-cased. Null and empty texts have none
and are never found. Repeated rows each count as a document. Null ids sort last among equal scores. Items without terms
find nothing; repeated items are each answered. Empty tables give empty results. Other columns are not read.

Items are taken in blocks of about ``BLOCK_TERMS`` terms: a block's terms and thresholds are what tasks get and what the
driver holds. An item of more terms is a block of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.llm.common import in_arrow, slices, stored, table, text_of, word_hashes, words_of

#: Places of a sketch (a power of two, up to 2^16), texts scored first for each item, terms of a block of items.
COORDINATES, FIRST, BLOCK_TERMS = 1 << 16, 32, 200_000

# what each byte of a term becomes; all others end a term
FOLD = np.full(256, ord(" "), np.uint8)
FOLD[128:] = np.arange(128, 256)
for first, last, to in (("0", "9", "0"), ("a", "z", "a"), ("A", "Z", "a")):
    FOLD[ord(first) : ord(last) + 1] = np.arange(ord(last) - ord(first) + 1) + ord(to)


def folded(texts: pa.Array) -> pa.Array:
    """Texts with their terms in lower case and one kind of white space for all that is no term."""
    texts = pa.concat_arrays([texts.cast(pa.string())])  # without an offset
    sizes = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[sizes[0] : sizes[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((sizes - sizes[0]).astype(np.int32)), pa.py_buffer(FOLD[data])])


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all terms, where each text's terms start, distinct terms."""
    return words_of(folded(texts))


def counted(codes: np.ndarray, starts: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) of the terms that each text holds."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pairs, times = np.unique(text * max(distinct, 1) + codes, return_counts=True)
    return pairs // max(distinct, 1), pairs % max(distinct, 1), times


def impact(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a text's number of terms counts against it."""
    return 100 - 90 + (90 * n.astype(np.int64) * documents) // max(total, 1)


class Block:
    """Items of one block: their distinct terms, and pairs of (term, item), by term."""

    def __init__(self, texts: list[str | None]):
        codes, starts, self.terms = terms_of(pa.array(["" if t is None else t for t in texts], pa.string()))
        self.items = len(texts)
        item, term, _ = counted(codes, starts, len(self.terms))
        order = np.lexsort((item, term))
        self.item, self.term = item[order], term[order]
        self.place = (word_hashes(self.terms) % np.uint64(COORDINATES)).astype(np.int64)
        self.weight = np.zeros(len(self.terms))

    def weigh(self, documents: int, holding: dict[int, int]) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(k, 0) + 1))) for k in range(len(self.terms))], float)

    def sums(self, row: np.ndarray, key: np.ndarray, value: np.ndarray, keys: np.ndarray, rows: int) -> np.ndarray:
        """Rows times items: sums of weight * value over the item's terms whose key stands in the row."""
        order = np.argsort(keys[self.term], kind="stable")
        item, weight, sorted_ = self.item[order], self.weight[self.term[order]], keys[self.term[order]]
        low, high = np.searchsorted(sorted_, key, "left"), np.searchsorted(sorted_, key, "right")
        n = high - low
        at = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        cell = np.repeat(row, n) * self.items + item[at]
        # whole numbers below 2^53, so that doubles add them exactly
        return np.bincount(cell, np.repeat(value, n) * weight[at], rows * self.items).reshape(rows, self.items)


def _statistics(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """(term, rows): documents that hold each term; documents with terms under -1, all terms under -2."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 2, np.int64)
        for batch in slices(batches, most=3 << 20):
            codes, starts, distinct = terms_of(text_of(batch))
            total[-1] += int((np.diff(starts) > 0).sum())
            total[-2] += len(codes)
            at = pc.fill_null(pc.index_in(distinct, value_set=terms), -1).to_numpy(zero_copy_only=False)
            asked = at[codes] >= 0
            text = np.repeat(np.arange(batch.num_rows), np.diff(starts))[asked]
            pairs = np.unique(text * max(len(terms), 1) + at[codes][asked])
            total[: len(terms)] += np.bincount(pairs % max(len(terms), 1), minlength=len(terms))[: len(terms)]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(some < len(terms), some, some - len(terms) - 2)), pa.array(total[some])], ["term", "rows"])

    return in_arrow(docs.select("text"), count, "term long, rows long").groupBy("term").agg(F.sum("rows").alias("rows"))


def sketched(docs: DataFrame, documents: int, total: int, k: int) -> DataFrame:
    """(digest, doc_id, nth, places, maxima) of the ``k`` rows of each text with the smallest ids; sketches on the first."""
    digest = F.md5(F.col("text").cast("binary"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3 << 20):
            codes, starts, distinct = terms_of(text_of(batch))
            row, term, times = counted(codes, starts, len(distinct))
            place = (word_hashes(distinct) % np.uint64(COORDINATES)).astype(np.int64)[term] if len(distinct) else term
            value = impact(times, lengths(np.diff(starts), documents, total)[row])
            order = np.lexsort((-value, place, row))
            row, place, value = row[order], place[order], value[order]
            top = np.ones(len(row), bool)
            top[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
            ends = np.searchsorted(row[top], np.arange(batch.num_rows + 1))
            places, maxima = place[top].astype("<u2"), value[top].astype("<u4")
            some = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.select(["digest", "doc_id"]).take(pa.array(some)).columns,
                    pa.array([places[ends[r] : ends[r + 1]].tobytes() for r in some], pa.binary()),
                    pa.array([maxima[ends[r] : ends[r + 1]].tobytes() for r in some], pa.binary()),
                ],
                ["digest", "doc_id", "places", "maxima"],
            )

    rows = in_arrow(docs.select("doc_id", "text", digest.alias("digest")), fold, "digest string, doc_id long, places binary, maxima binary")
    nth = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last()))
    rows = rows.withColumn("nth", nth).filter(F.col("nth") <= k)
    first = F.col("nth") == 1
    return rows.select("digest", "doc_id", "nth", F.when(first, F.col("places")).alias("places"), F.when(first, F.col("maxima")).alias("maxima"))


def _bounds(batch: pa.RecordBatch, block: Block) -> np.ndarray:
    """Texts times items: upper bounds of the scores."""

    def flat(name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
        each = [np.frombuffer(b.as_py(), kind) for b in batch.column(batch.schema.get_field_index(name))]
        return np.repeat(np.arange(len(each)), [len(e) for e in each]), np.concatenate(each) if each else np.zeros(0, kind)

    row, place = flat("places", "<u2")
    _, value = flat("maxima", "<u4")
    asked = np.zeros(COORDINATES, bool)
    asked[block.place] = True
    keep = asked[place]
    return block.sums(row[keep], place[keep].astype(np.int64), value[keep].astype(float), block.place, batch.num_rows)


def _first(sketches: DataFrame, block: Block) -> DataFrame:
    """(item, digest, doc_id, bound) of the texts of each item with the largest bounds."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, bounds, least = np.zeros(0, np.int64), np.zeros(0), np.zeros(block.items)
        kept: pa.Table | None = None
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                got = _bounds(part, block)
                if part.num_rows > FIRST:
                    got[got < np.partition(got, -FIRST, axis=0)[-FIRST]] = 0
                row, item = np.nonzero(got > least)
                items, bounds = np.concatenate([items, item]), np.concatenate([bounds, got[row, item]])
                new = pa.Table.from_batches([part.select(["digest", "doc_id"])]).take(pa.array(row))
                kept = new if kept is None else pa.concat_tables([kept, new])
                order = np.lexsort((-bounds, items))
                nth = np.arange(len(order)) - np.searchsorted(items[order], items[order])
                full = order[nth == FIRST - 1]
                least[items[full]] = bounds[full]
                order = order[nth < FIRST]
                items, bounds, kept = items[order], bounds[order], kept.take(pa.array(order)).combine_chunks()
        if kept is not None:
            for part in kept.append_column("item", pa.array(items)).append_column("bound", pa.array(bounds)).select(["item", "digest", "doc_id", "bound"]).combine_chunks().to_batches(10_000):
                yield part

    rows = in_arrow(sketches.select("digest", "doc_id", "places", "maxima"), most, "item long, digest string, doc_id long, bound double")
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), "digest"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= FIRST).drop("nth")


def _reaching(sketches: DataFrame, block: Block, least: np.ndarray) -> DataFrame:
    """(item, digest, doc_id) of all texts whose bound reaches the item's threshold."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                row, item = np.nonzero(_bounds(part, block) >= least)
                yield pa.RecordBatch.from_arrays([pa.array(item), *part.select(["digest", "doc_id"]).take(pa.array(row)).columns], ["item", "digest", "doc_id"])

    return in_arrow(sketches.select("digest", "doc_id", "places", "maxima"), reach, "item long, digest string, doc_id long")


def _scored(docs: DataFrame, candidates: DataFrame, block: Block, documents: int, total: int, bounded: bool) -> DataFrame:
    """(item, digest, score) of the candidates (item, digest, doc_id), exactly, from their whole texts.

    ``bounded`` says that the candidates have a bound (items of a block times ``FIRST``) and may be broadcast.
    """
    wanted = candidates.groupBy("digest", "doc_id").agg(F.collect_list("item").alias("items"))
    wanted = wanted.select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_doc_id"), "items")
    texts = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("digest"))
    meet = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    rows = texts.join(F.broadcast(wanted) if bounded else wanted, meet).select("digest", "text", "items")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3 << 20):
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                codes, starts, distinct = terms_of(text_of(part))
                at = pc.fill_null(pc.index_in(distinct, value_set=block.terms), -1).to_numpy(zero_copy_only=False)
                row, term, times = counted(codes, starts, len(distinct))
                value = impact(times, lengths(np.diff(starts), documents, total)[row])
                keep = at[term] >= 0 if len(term) else np.zeros(0, bool)
                got = block.sums(row[keep], at[term[keep]], value[keep].astype(float), np.arange(len(block.terms)), part.num_rows)
                lists = part.column(part.schema.get_field_index("items"))
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                item = lists.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(item), part.column(0).take(pa.array(row)), pa.array(got[row, item].astype(np.int64))], ["item", "digest", "score"])

    return in_arrow(rows, score, "item long, digest string, score long").filter("score > 0").groupBy("item", "digest").agg(F.max("score").alias("score"))


def _best(scores: DataFrame, sketches: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of the best documents, with all copies of the texts that can be among them."""
    rows = scores.join(sketches.select("digest", "doc_id"), "digest")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = items.select("item_id", F.col("text").cast("string").alias("text"), F.length("text").alias("_size"))
    blocks = math.ceil((sized.agg(F.sum("_size")).first()[0] or 0) / (6 * BLOCK_TERMS)) or 1
    sized = sized.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out, sketches, statistics = None, None, {}
    for b in range(blocks):
        rows = sized.filter(F.col("_block") == b).orderBy("item_id", "text").select("item_id", "text").collect()
        block = Block([r.text for r in rows])
        statistics = {r.term: r.rows for r in _statistics(docs, block.terms).collect()}
        documents, total = statistics.get(-1, 0), statistics.get(-2, 0)
        block.weigh(documents, statistics)
        if sketches is None:
            sketches = stored(sketched(docs, documents, total, k), "sketches")
        filled = sketches.filter("nth = 1")
        if rows:
            first = stored(_first(filled, block), "first")
            best = _best(_scored(docs, first, block, documents, total, True), sketches, k)
            kth = {r.item: r.score for r in best.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") == k).collect()}
            least = np.array([max(kth.get(i, 1), 1) for i in range(len(rows))], float)
            rest = stored(_reaching(filled, block, least), "reaching")
            best = _best(_scored(docs, rest, block, documents, total, False), sketches, k)
        else:
            best = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        got = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        got = stored(got, "ranked") if blocks > 1 else got
        out = got if out is None else out.unionByName(got)
    return out


def op12_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {"op12_max_sketch_search": op12_max_sketch_search}
TERMS = "list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = {
    "op12_max_sketch_search": f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {TERMS} AS terms FROM documents
), filled AS (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM docs WHERE len(terms) > 0
), totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM filled
), counts AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM filled) GROUP BY row, term
), asked AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark
), held AS (SELECT term, count(*) AS df FROM counts WHERE term IN (SELECT term FROM asked) GROUP BY term
), weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM held, totals
), lengths AS (SELECT row, doc_id, 100 - 90 + (90 * n * docs) // total AS m FROM filled, totals
), scores AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (row) GROUP BY item_id, row, doc_id
), ranks AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM ranks WHERE rank <= 10
"""
}
