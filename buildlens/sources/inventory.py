"""Blob directories as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from buildlens.functions import exprs as X

SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"


def digests_of_listing(listing: DataFrame, root: str) -> DataFrame:
    """Digest from the path below ``root``: one part, or two level directories and the rest; 64 characters in all.

    Anything else, and everything below a dot-entry, is not a blob. A path that is not below ``root`` is an error.
    """
    # the scheme and its authority are left out on both sides, as listings may or may not carry them
    base = re.sub(SCHEME, "", root).rstrip("/") + "/"
    bare = F.regexp_replace("path", SCHEME, "")
    outside = F.raise_error(F.concat(F.lit(f"not below {base}: "), F.col("path")))
    relative = F.when(F.startswith(bare, F.lit(base)), F.substr(bare, F.lit(len(base) + 1))).otherwise(outside)
    parts = F.split(relative, "/")
    joined = F.when(F.size(parts).isin(1, 3), F.array_join(parts, ""))
    hidden = relative.rlike(r"(^|/)\.")
    return listing.withColumn("hash", F.when(~hidden, X.canonical_digest(joined))).filter(F.col("hash").isNotNull())


LISTED = "path string, size_bytes bigint, modified timestamp"
#: Rows of a batch of a listing.
LISTED_ROWS = 10_000


def _place(root: str):
    """File system and path of a root, given as a URI or as a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if re.match(SCHEME, root) else (fs.LocalFileSystem(), root)


class BlobListing(DataSource):
    """Files below ``root``: one input partition for each of the 256 directories that two hexadecimal digits name, and
    one for all else (files at the root, directories of other names). Nothing is listed on the driver."""

    @classmethod
    def name(cls) -> str:
        return "blob_listing"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ListingReader(self.options["root"].rstrip("/"))


class _ListingReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f"{i:02x}") for i in range(256)] + [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = _place(self.root)

        def below(path: str, recursive: bool = True):
            return system.get_file_info(fs.FileSelector(path, allow_not_found=partition.value is not None, recursive=recursive))

        if partition.value is not None:
            found = below(f"{base}/{partition.value}")
        else:
            found = []
            for entry in below(base, recursive=False):
                if entry.type == fs.FileType.File:
                    found.append(entry)
                elif not re.fullmatch("[0-9a-f]{2}", entry.base_name) and not entry.base_name.startswith("."):
                    found += below(entry.path)
        files = [f for f in found if f.type == fs.FileType.File]
        for at in range(0, len(files), LISTED_ROWS):
            part = files[at : at + LISTED_ROWS]
            times = pa.array([f.mtime_ns // 1000 for f in part], pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array([f.path for f in part]), pa.array([f.size for f in part], pa.int64()), times], ["path", "size_bytes", "modified"])


def scan_blob_inventory(spark: SparkSession, root: str) -> DataFrame:
    """List a blob directory in tasks; contents are never read. A root that is not there is an error."""
    spark.dataSource.register(BlobListing)
    _, base = _place(root.rstrip("/"))
    listing = spark.read.format("blob_listing").option("root", root).load()
    return digests_of_listing(listing, base).select("hash", "size_bytes", "modified")


def write_blob_files(contents: DataFrame, root: str) -> None:
    """Write (hash, content) as files in two levels of directories; each appears whole or not at all, so that a task may
    run twice."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, base = _place(root.rstrip("/"))
        for batch in batches:
            for digest, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{base}/{digest[:2]}/{digest[2:4]}"
                part = f"{folder}/.{digest[4:]}-{uuid.uuid4().hex}"
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, f"{folder}/{digest[4:]}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    rows = contents.select("hash", F.col("content").cast("binary").alias("content"))
    rows.mapInArrow(put, "files bigint").agg(F.sum("files")).collect()
