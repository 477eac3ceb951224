"""Packing along a space-filling curve.

A document's tokens are hashed to random signs in ``DIMS`` dimensions; the normalised sums are a projection of its token
counts, in which documents of like tokens lie close. The Hilbert key of the projected point orders the documents on one
curve. A range sort by that key deals the curve into stretches, and each stretch's documents are laid end to end and cut
every ``length`` ids, so neighbours on the curve share a sequence. Only the last sequence of a stretch is not full, and
the number of stretches follows the number of ids, so padding stays below ``length / STRETCH_IDS`` of them.

A document is the ids of its whole text and then ``end_id``; null and empty texts are the end id alone. Equal texts have
equal keys and are told apart by ``doc_id`` and place in the table, so a large group of copies is cut like any others.
Null ids are kept. Repeated rows are packed each. Only id and text are read, so other columns can't clash. An empty
table gives no pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import encoder_of, in_arrow, mixed, slices, stored, table, text_of, with_end, word_hashes

#: Dimensions of the projection and bits of each in the key; ids of a stretch of the curve on average.
DIMS, BITS, STRETCH_IDS = 4, 8, 4_000_000
#: Shortest tokens that place a document.
LEAST_BYTES = 4
LENGTH, END_ID = 2048, 1


@lru_cache(maxsize=2)
def directions(tokenizer: str) -> np.ndarray:
    """For each token id its sign in each dimension and, last, its weight: 0 for tokens of fewer than ``LEAST_BYTES``,
    which are in most documents of a language."""
    encoder = encoder_of(tokenizer)
    names = pa.array([(encoder.tokenizer.id_to_token(k) or "").removesuffix("</w>") for k in range(encoder.mark)], pa.string())
    weight = pc.greater_equal(pc.binary_length(names), LEAST_BYTES).to_numpy(zero_copy_only=False).astype(np.int32)
    hashes = mixed(word_hashes(names))
    signs = [1 - 2 * ((hashes >> np.uint64(d)) & np.uint64(1)).astype(np.int32) for d in range(DIMS)]
    return np.stack([*(s * weight for s in signs), weight])


def projected(ids: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A point with ``DIMS`` coordinates in 0 to 2**BITS - 1 for each text, from its ids (at least one each)."""
    *sums, norm = (np.add.reduceat(one[ids], starts[:-1], dtype=np.int64) for one in table)
    # near normal values in units of their deviation; a logistic curve spreads them over the cells
    spread = 1 / (1 + np.exp(np.clip(-1.702 * np.stack(sums, 1) / np.sqrt(np.maximum(norm, 1))[:, None], -60, 60)))
    return np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of points on the Hilbert curve: the axes are turned cell by cell from the coarsest, then Gray-decoded."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for d in range(dims):
            upper = (x[d] & q) != 0
            swap = np.where(upper, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[dims - 1] & (1 << bit)) != 0, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> bit) & 1)
    return key


def on_curve(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, place, n_tokens, ids) with ids as little-endian unsigned 32-bit integers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, signs = encoder_of(tokenizer), directions(tokenizer)
        for batch in slices(batches):
            texts = text_of(batch)
            ids, starts = with_end(*encoder.encode(texts), end_id)
            flat = pa.py_buffer(ids.astype("<u4").tobytes())
            binary = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * starts).astype(np.int32).tobytes()), flat])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hilbert(projected(ids, starts, signs))), pa.array(np.diff(starts)), binary], ["doc_id", "place", "n_tokens", "ids"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_arrow(rows, encode, "doc_id long, place long, n_tokens long, ids binary")


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, at = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy()
            ends = at + np.cumsum(n)
            edges = np.unique(np.concatenate(([at], ends, np.arange(-(-at // length) * length, ends[-1], length))))
            start, size = edges[:-1], np.diff(edges)
            doc = np.searchsorted(ends, start, "right")
            inside = start - (ends[doc] - n[doc])
            ids = batch.column(2)
            views = {}
            pieces = []
            for d, a, s in zip(doc.tolist(), inside.tolist(), size.tolist()):
                if d not in views:
                    views = {d: ids[d].as_buffer()}
                pieces.append(views[d].slice(4 * a, 4 * s).to_pybytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(inside), pa.array(size), pa.array(pieces, pa.binary()), pa.array(n[doc]),
                 pa.array(base + start // length), pa.array(start % length)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            at = int(ends[-1])

    return cut


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); a sequence is its pieces by offset."""
    rows = stored(on_curve(docs, tokenizer, end_id), "curve")  # ranges are sampled from it, so it must not be made twice
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    key = ["place", "doc_id", "n_tokens"]
    ranged = rows.repartitionByRange(max(1, math.ceil(total / STRETCH_IDS)), *key).sortWithinPartitions(*key, "ids")
    return in_arrow(
        ranged.select("doc_id", "n_tokens", "ids"), _cut(length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"))


def packed_digests(docs: DataFrame) -> DataFrame:
    """The pieces of all documents, with a crc32 in place of the ids."""
    import public_tokenizers

    pieces = packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op6_curve_packing": op6_curve_packing}
SQL: dict[str, str] = {}
