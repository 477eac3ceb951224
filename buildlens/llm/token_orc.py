"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt by ranges of ``doc_id``, one file for each range, and sorted inside; the files follow each other
in ascending id order. Every file holds for each document its ids and their place within the file, so a reader needs
one number for each file, the ids of the files before it, to know the place in the whole stream. Stripes are read in
parallel; a lookup of some documents skips files, stripes and row groups by their statistics and Bloom filters.

Null and empty texts give the end id alone. Null document ids come first. Rows that share an id follow each other in
the order of their texts' hashes; rows equal in both are kept. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.llm.common import encoder_of, in_arrow, slices, table, text_of, with_end
from buildlens.session import scratch_path

#: ORC writer: rows for each row-index entry, bytes of a stripe, false positives of the Bloom filters.
ROW_INDEX_STRIDE, STRIPE_BYTES, BLOOM_FPP = 1000, 64 << 20, 0.01


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file_no, doc_id, file_start, n_tokens, ids) in ascending order of ids within each partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place, file_no = encoder_of(tokenizer), 0, TaskContext.get().partitionId()
        for batch in slices(batches):
            ids, starts = with_end(*encoder.encode(text_of(batch)), end_id)
            n = batch.num_rows
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.view("int32")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([file_no] * n, pa.int32()), batch.column(0), pa.array(place + starts[:-1], pa.int64()),
                 pa.array(starts[1:] - starts[:-1], pa.int64()), lists],
                ["file_no", "doc_id", "file_start", "n_tokens", "ids"],
            )
            place += int(starts[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # bounds of the ranges are sampled to the driver, so a hash stands for the text
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return in_arrow(ranged, encode, "file_no int, doc_id long, file_start long, n_tokens long, ids array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, **columns: str) -> None:
    """Encode every text, append ``end_id`` to each document and write ORC files below ``path``."""
    (
        encoded(docs, tokenizer, end_id, **columns)
        .write.option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before."""
    rows = spark.read.schema("file_no int, doc_id long, file_start long, n_tokens long, ids array<int>").orc(path)
    # one row for each file; the running sum over files is small whatever the corpus
    files = rows.groupBy("file_no").agg(F.max(F.col("file_start") + F.col("n_tokens")).alias("tokens"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    # 12 bytes for each file, so the ids need not be shuffled to meet them
    return rows.join(F.broadcast(files), "file_no").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents; statistics and Bloom filters leave out what cannot hold them."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """``ids_crc32`` instead of ``ids``: unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<i4")).cast("B")
            ends = lists.value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()
            crcs = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return in_arrow(rows.select("doc_id", "start", "n_tokens", "ids"), sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-orc")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return with_crc32(read_token_files(spark, path))


QUERIES = {"op1_token_orc": op1_token_orc}
SQL: dict[str, str] = {}
