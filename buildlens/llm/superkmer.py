"""Removal of repeated word windows by super-k-mers.

A window is 35 consecutive words. Its minimiser is the smallest hash among its runs of ``GRAM`` words; consecutive
windows with one minimiser form a super-k-mer, which travels to the minimiser's bucket as one packed string of words.
Equal windows have equal minimisers, so a bucket sees every copy of its windows and counts them exactly by sorting
their words.

1. Only places travel at first: (text, start, windows, minimiser). Copies of a text bring the same places, which count
   once; all windows of a text with copies are repeated. A minimiser with one place has no repeated window.
2. Super-k-mers of the others are packed from the distinct texts. Equal strings are counted before they travel.
3. Buckets sort their windows. A minimiser with more than ``HOT`` places (a passage in a large share of all documents)
   would make one bucket too large: its strings are cut into single windows, which are dealt by their words.
4. Repeated places come back to the texts, whose words they cover are removed. Windows are judged on the input.

Words stand between ASCII white space. Null texts have no words. Rows with null or repeated ids count as documents of
their own; ids are not read. Texts of fewer than 35 words are left as they are. Extra columns are kept. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import free_name, gram_hashes, in_arrow, slices, stored, table, text_of, whole_groups, word_hashes, words_of
from buildlens.session import prepared

#: Words of a window and of a minimiser; windows of one packed string at most; places that make a minimiser hot.
WINDOW, GRAM, RUN_WINDOWS, HOT = 35, 8, 256, 2_000
#: Low bits that hold a word's place in a batch while the smallest hash is sought; the bits above order the hashes.
PLACE = np.uint64((1 << 32) - 1)


def _text_hash(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of ``n``: runs of 1, 2, 4, ... are joined, two overlapping ones give the last step."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest and len(x) > rest else x if not rest else x[:0]


def super_kmers(texts: pa.Array, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each super-k-mer: row, first word, windows, minimiser, places of the minimiser that its windows chose.

    A window's minimiser is the first of equal ones, so windows of one place all differ; a single super-k-mer can only
    hold equal windows if they chose several places.
    """
    codes, starts, distinct = words_of(texts)
    hashes = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    grams, _ = gram_hashes(hashes, np.array([0, len(hashes)]), gram)
    least = _sliding_min((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & PLACE
    counts = np.maximum(np.diff(starts) - (window - 1), 0)
    total = int(counts.sum())
    row = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    inside = np.arange(total) - begin[row]
    place = least[starts[row] + inside].astype(np.int64)
    value = grams[place]
    moved, change = np.ones(total, bool), np.ones(total, bool)
    moved[1:] = place[1:] != place[:-1]
    change[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1]) | (inside[1:] % RUN_WINDOWS == 0)
    at = np.flatnonzero(change)
    places = np.maximum(np.add.reduceat(moved.astype(np.int64), at), 1) if len(at) else np.zeros(0, np.int64)
    return row[at], inside[at], np.diff(np.concatenate((at, [total]))), value[at].view(np.int64), places


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=3 << 20):
        row, start, n, value, places = super_kmers(text_of(batch))
        own = batch.column(batch.schema.get_field_index("text_hash")).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([own, pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(value), pa.array(places, pa.int32())], ["text_hash", "start", "n", "minimiser", "places"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=3 << 20):
        codes, starts, distinct = words_of(text_of(batch))
        words = distinct.to_pylist()
        runs = batch.column(batch.schema.get_field_index("runs"))
        row = np.repeat(np.arange(batch.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))
        flat = runs.flatten()
        start, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
        packed = [" ".join([words[c] for c in codes[a : a + k]]) for a, k in zip((starts[row] + start).tolist(), (n + WINDOW - 1).tolist())]
        own = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in ("text_hash", "copies")]
        yield pa.RecordBatch.from_arrays([*own, flat.field("start"), flat.field("minimiser"), flat.field("hot"), pa.array(packed, pa.string())], ["text_hash", "copies", "start", "minimiser", "hot", "packed"])


def _windows(packed: str) -> list[str]:
    ends, at = [-1], packed.find(" ")
    while at >= 0:
        ends.append(at)
        at = packed.find(" ", at + 1)
    ends.append(len(packed))
    return [packed[ends[k] + 1 : ends[k + WINDOW]] for k in range(len(ends) - WINDOW)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each bucket that occur more than once: string and places of the windows in it."""
    for rows, cuts in whole_groups(batches, ["minimiser"]):
        strings, copies = rows["packed"].to_pylist(), rows["copies"].to_pylist()
        marks: dict[int, list[int]] = {}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            found = sorted((w, r, k) for r in range(a, b) for k, w in enumerate(_windows(strings[r])))
            begin = 0
            for end in range(1, len(found) + 1):
                if end == len(found) or found[end][0] != found[begin][0]:
                    if end - begin > 1 or copies[found[begin][1]] > 1:
                        for _, r, k in found[begin:end]:
                            marks.setdefault(r, []).append(k)
                    begin = end
        at = sorted(marks)
        yield pa.RecordBatch.from_arrays(
            [rows["minimiser"].take(pa.array(at, pa.int64())).combine_chunks(), rows["string"].take(pa.array(at, pa.int64())).combine_chunks(), pa.array([marks[r] for r in at], pa.list_(pa.int32()))],
            ["minimiser", "string", "marks"],
        )


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of strings, one row each."""
    for batch in slices(batches, "packed", most=1 << 20):
        each = [_windows(s) for s in batch.column(batch.schema.get_field_index("packed")).to_pylist()]
        rows = np.repeat(np.arange(len(each)), [len(w) for w in each])
        ids = batch.select(["minimiser", "string", "copies"]).take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([*ids.columns, pa.array([k for w in each for k in range(len(w))], pa.int32()), pa.array([x for w in each for x in w], pa.string())], ["minimiser", "string", "copies", "k", "words"])


def repeated_places(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(text_hash, copies, runs of (start, marks)) of all texts that have copies or repeated windows: windows
    start + mark are repeated. All windows of a text with copies are, so those have no runs listed."""
    prepared(docs.sparkSession)  # skewed joins are split
    texts = docs.select(_text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    counts = texts.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"))
    places = stored(in_arrow(texts, _places, "text_hash binary, start int, n int, minimiser long, places int"), "places")
    # copies of a text bring the same places, which are one: the least and greatest of their hashes tell whether a
    # minimiser has others
    at = F.xxhash64("text_hash", "start")
    least = places.groupBy("minimiser").agg(F.min(at).alias("least"), F.max(at).alias("most"), F.max("places").alias("own"), F.sum("places").alias("places"))
    several = least.filter("least <> most OR own > 1").select("minimiser", (F.col("places") > hot).alias("hot"))
    wanted = places.drop("places").join(several, "minimiser").groupBy("text_hash").agg(F.collect_set(F.struct("start", "n", "minimiser", "hot")).alias("runs"))
    counts = stored(counts.join(wanted, "text_hash", "left").filter("copies > 1 OR runs IS NOT NULL"), "counts")
    flagged = texts.dropDuplicates(["text_hash"]).join(counts.filter("runs IS NOT NULL"), "text_hash")
    strings = in_arrow(flagged, _packed, "text_hash binary, copies long, start int, minimiser long, hot boolean, packed string")
    strings = stored(strings.withColumn("string", F.unhex(F.md5("packed"))), "strings")
    distinct = strings.groupBy("minimiser", "hot", "string", "packed").agg(F.sum("copies").alias("copies"))
    cold = distinct.filter("NOT hot").repartition("minimiser").sortWithinPartitions("minimiser").select("minimiser", "string", "packed", "copies")
    marks = in_arrow(cold, _counted, "minimiser long, string binary, marks array<int>")
    single = stored(in_arrow(distinct.filter("hot").select("minimiser", "string", "packed", "copies"), _single, "minimiser long, string binary, copies long, k int, words string"), "windows")
    again = single.groupBy("words").agg(F.sum("copies").alias("times")).filter("times > 1").select("words")
    hot_marks = single.join(again, "words").groupBy("minimiser", "string").agg(F.collect_list("k").alias("marks"))
    found = strings.filter("copies = 1").select("text_hash", "start", "minimiser", "string").join(marks.union(hot_marks), ["minimiser", "string"])
    found = found.groupBy("text_hash").agg(F.collect_list(F.struct("start", "marks")).alias("runs"))
    kind = found.schema["runs"].dataType.simpleString()
    return found.select("text_hash", F.lit(1).cast("long").alias("copies"), "runs").union(counts.filter("copies > 1").select("text_hash", "copies", F.lit(None).cast(kind)))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kept`` (words left, joined by one space), ``n_words`` and ``n_removed``; input columns of these
    names are replaced."""
    docs = docs.drop("kept", "n_words", "n_removed")
    own, copies, runs = (free_name(docs, n) for n in ("text_hash", "copies", "runs"))
    found = repeated_places(docs).toDF(own, copies, runs)
    rows = docs.join(found, _text_hash() == F.col(own), "left").select(*[docs[f"`{c}`"] for c in docs.columns], copies, runs)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["kept string", "n_words long", "n_removed long"])
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3 << 20):
            codes, starts, distinct = words_of(text_of(batch))
            words = distinct.to_pylist()
            kept, removed = [], []
            for k, (copies, runs) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist())):
                own = codes[starts[k] : starts[k + 1]]
                if (copies or 0) > 1:  # every window occurs again
                    left = own if len(own) < WINDOW else own[:0]
                elif runs:
                    change = np.zeros(len(own) + 1, np.int64)
                    at = np.concatenate([np.array(r["marks"], np.int64) + r["start"] for r in runs])
                    np.add.at(change, at, 1)
                    np.add.at(change, at + WINDOW, -1)
                    left = own[np.cumsum(change)[:-1] == 0]
                else:
                    left = own
                kept.append(" ".join([words[c] for c in left]))
                removed.append(len(own) - len(left))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(kept, pa.string()), pa.array(np.diff(starts)), pa.array(removed, pa.int64())], [*names, "kept", "n_words", "n_removed"]
            )

    return in_arrow(rows, cut, schema)


def cleaned(docs: DataFrame) -> DataFrame:
    """Documents without their repeated windows, in the columns of ``docs``; other texts stay as they are."""
    names = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in ("kept", "n_words", "n_removed")}
    rows = without_repeats(docs.withColumnsRenamed(names))
    out = rows.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def op7_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op7_superkmer_dedup": op7_superkmer_dedup}
SQL = {
    "op7_superkmer_dedup": """
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM split
), windows AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS words FROM starts
), again AS (SELECT words FROM windows GROUP BY words HAVING count(*) > 1
), covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM windows JOIN again USING (words)
), placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM placed ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
}
