"""Helpers shared by the operators: tables, written intermediate results, words and tokens of Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from buildlens.session import scratch_path

#: Entries that a task's word cache may hold before it starts anew.
CACHE_WORDS = 250_000
#: Bytes of an Arrow batch on its way to and from a task's Python, so that both sides stay small with long texts.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:8]}")
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, as Spark compares names."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column with null as the empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "")


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between runs of ASCII white space: codes of all words, start of each text in them (with the end of the
    last), and the distinct words that the codes number."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # white space at an end of a text
        keep = codes != empty
        text = np.repeat(np.arange(len(sizes)), sizes)
        codes, sizes = codes[keep], np.bincount(text[keep], minlength=len(sizes))
    return codes, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), coded.dictionary


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole word (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words."""
    import xxhash

    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(w) for w in words.to_pylist()), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and where each text's runs start among them. A text of fewer words has none."""
    sizes = np.maximum(np.diff(starts) - (n - 1), 0)
    run_starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    total = max(len(hashes) - (n - 1), 0)
    rolled = np.zeros(total, np.uint64)
    for i in range(n):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15 | 1) + hashes[i : i + total]
    at = np.arange(run_starts[-1]) + np.repeat(starts[:-1] - run_starts[:-1], sizes)
    return mixed(rolled[at]), run_starts


def gathered(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[ends[r]:ends[r + 1]]`` one after the other for each r of ``rows``, and where each starts."""
    sizes = ends[rows + 1] - ends[rows]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    kind = np.int32 if max(starts[-1], len(flat)) < 1 << 31 else np.int64
    at = np.arange(starts[-1], dtype=kind)
    at += np.repeat((ends[rows] - starts[:-1]).astype(kind), sizes)
    return flat[at], starts


class Encoder:
    """Token ids of whole texts by a file of the tokenizers library.

    Both public files end a token before a space that follows no white space, and between a letter and ASCII
    punctuation, so a text's ids are the ids of its parts, cut there. Equal parts are cut and encoded once for each
    batch, and the pieces are kept for later batches.
    """

    #: Cuts a space away from what stands before it, unless that is white space too.
    SPACE = "([^\\s\\x0b\\x1c-\\x1f\\x85\\pZ]) "
    RUN = "[\\s\\x0b\\x1c-\\x1f\\x85\\pZ] "
    PUNCTUATION = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([!-/:-@\\[-`{-~])"

    def __init__(self, path: str):
        from tokenizers import AddedToken, Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # parts are encoded in one text, with a token of its own after each
        self.tokenizer.add_tokens([AddedToken("\0", normalized=False, special=False)])
        self.mark = self.tokenizer.token_to_id("\0")
        self.kept = pa.array([], pa.string())
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that may hold the mark."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        got = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got]

    @staticmethod
    def split(marked: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Codes of the parts between marks, where each text's parts start, the distinct parts."""
        lists = pc.split_pattern(marked, "\0")
        coded = lists.flatten().dictionary_encode()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        return coded.indices.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), coded.dictionary

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start (with the end of the last)."""
        held = pc.match_substring(texts, "\0")  # texts that hold the mark itself are encoded as they are
        marked = pc.if_else(held, "", texts)
        runs = pc.match_substring_regex(marked, self.RUN)
        plain = pc.replace_substring(marked, " ", "\0 ")
        if pc.any(runs).as_py():
            plain = pc.if_else(runs, pc.replace_substring_regex(marked, self.SPACE, "\\1\0 "), plain)
        codes, part_starts, distinct = self.split(plain)
        piece_codes, piece_starts, pieces = self.split(pc.replace_substring_regex(distinct, self.PUNCTUATION, "\\1\0\\2"))
        rows = self.rows_of(pieces)[piece_codes]
        piece_ids, at = gathered(self.flat, self.ends, rows)
        ids, first = gathered(piece_ids, at[piece_starts], codes)
        starts = first[part_starts]
        if pc.any(held).as_py():
            each = [ids[a:b] for a, b in zip(starts[:-1], starts[1:])]
            rows = np.flatnonzero(held.to_numpy(zero_copy_only=False))
            for r, got in zip(rows, self.plain([texts[int(r)].as_py() for r in rows])):
                each[r] = got
            ids = np.concatenate(each)
            starts = np.concatenate(([0], np.cumsum([len(p) for p in each])))
        return ids, starts

    def rows_of(self, parts: pa.Array) -> np.ndarray:
        """Where ``flat`` holds the ids of the parts; new parts are encoded and added."""
        at = pc.index_in(parts, value_set=self.kept)
        fresh = pc.is_null(at)
        new = parts.filter(fresh)
        fresh = fresh.to_numpy(zero_copy_only=False)
        rows = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends, kept = self.flat, self.ends, self.kept
        if len(kept) and len(kept) + len(new) > CACHE_WORDS:  # keep what this batch needs too
            flat, ends = gathered(flat, ends, rows[~fresh])
            kept = parts.filter(pa.array(~fresh))
            rows[~fresh] = np.arange(len(kept))
        rows[fresh] = len(kept) + np.arange(len(new))
        sizes, flats = [np.zeros(0, np.int64)], [flat]
        for k in range(0, len(new), 10_000):  # the library's own results are large
            text = "\0".join([*new.slice(k, 10_000).to_pylist(), ""])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            sizes.append(np.diff(cuts, prepend=-1) - 1)
            flats.append(np.delete(ids, cuts))
        ends = np.concatenate([ends, ends[-1] + np.cumsum(np.concatenate(sizes))])
        # all at once, as a later task of this Python process goes on with them
        self.flat, self.ends, self.kept = np.concatenate(flats), ends, pa.concat_arrays([kept, new])
        return rows


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder of this Python process: tasks that follow each other in it share the parts it keeps, whose number has
    a bound."""
    return Encoder(path)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each take no more than ``most`` bytes (or are a single row)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(text_of(batch, column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, filled = 0, 0
        ends = np.cumsum(sizes)
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(ends, filled + most, "right")))
            yield batch.slice(begin, end - begin)
            begin, filled = end, int(ends[end - 1])


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` after those of each text."""
    return np.insert(ids, starts[1:], end_id).astype(np.uint32), starts + np.arange(len(starts))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by ``keys``, and where each group starts (with the end of the last)."""
    rest: pa.Table | None = None

    def cuts_of(rows: pa.Table) -> np.ndarray:
        change = np.zeros(rows.num_rows, bool)
        for k in keys:
            col = rows[k].combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= col[1:] != col[:-1]
        return np.concatenate(([0], np.flatnonzero(change), [rows.num_rows]))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows]).combine_chunks()
        cuts = cuts_of(rows)
        if len(cuts) > 2:
            yield rows.slice(0, cuts[-2]), cuts[:-1]
        rest = rows.slice(cuts[-2])
    if rest is not None:
        yield rest, cuts_of(rest)
