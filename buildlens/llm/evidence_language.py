"""Language identification by fusing evidence in Bayes' rule.

Evidence of a row: its text, the language that its markup declares, the suffix of its address, and its host.

* Text: likelihoods of hashed byte 4-grams under each language, counted on a sample of distinct labelled texts with a
  quota for each language, and under an "und" class of letters drawn one by one. Overlapping grams repeat evidence, so the sum is divided by their length.
* Host: the share of each language among the host's *other* rows, as the text alone judges them, drawn towards the
  share of its address suffix, which is drawn towards that of all rows (``DRAW`` rows each). All by grouped sums.
* Markup: how often rows of each language (as the text judges them) declare this one, from grouped sums, smoothed.

A row is rejected if its best class is "und" or the best posterior is below ``least``. Whole texts are read. Null texts
count as empty; they have no text evidence, so the host decides, and with nothing known the share of languages in the
corpus. Missing evidence (null or empty markup, suffix or host) is left out. Repeated rows are judged alike. Rows are
told apart by id and text. Tables without labelled rows have "und" alone, and nothing can be rejected from them: then
no row is. Extra columns are not read by ``identified`` and are kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import in_arrow, slices, stored, table, text_of

#: Labelled rows that the text model is fitted on (about), buckets of 4-grams, letters of a gram.
SAMPLE_ROWS, BUCKETS, GRAM = 8_000, 1 << 15, 4
#: Quota of each language where its part of ``SAMPLE_ROWS`` would be less; languages whose counts a task or the driver
#: holds at a time; likelihoods that a task works out at a time.
LANGUAGE_ROWS, HELD_LANGUAGES, HELD_LIKELIHOODS = 500, 64, 1 << 20
#: Rows that a parent's share counts as, rows that a declared language starts with, prior of "und".
DRAW, DECLARED_START, UND = 20.0, 1.0, 0.01
LEAST = 0.35
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Bytes of letters as they are, in lower case; all others as a space."""
    to = np.full(256, 32, np.uint8)
    low = np.arange(ord("a"), ord("z") + 1)
    to[low], to[low - 32] = low, low
    to[128:] = np.arange(128, 256)
    return to


LETTERS = _letters()


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, bucket of the gram that starts at each byte, whether it counts, and the texts' starts."""
    raw = pc.utf8_lower(texts).cast(pa.large_binary())
    buffers, n = raw.buffers(), len(raw)
    ends = np.frombuffer(buffers[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    starts = ends - ends[0]
    b = LETTERS[data]
    total = max(len(b) - GRAM + 1, 0)
    code = np.zeros(total, np.uint32)
    letters = np.zeros(total, np.uint8)
    for i in range(GRAM):
        code = (code << np.uint32(8)) | b[i : i + total]
        letters += b[i : i + total] != 32
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int32)
    counts = letters >= 2
    for last in range(1, GRAM):  # grams that would run into the next text
        at = starts[1:] - last
        counts[at[(at >= 0) & (at < total)]] = False
    return b, bucket, counts, starts


def sampled(rows: DataFrame, lang: str = "lang", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, text): distinct labelled texts. A language with no more of them than its quota is taken whole, others by a
    hash, so that about the quota is left. Languages share ``sample_rows``, but have ``LANGUAGE_ROWS`` each at least."""
    labelled = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    labelled = labelled.withColumn("hash", F.xxhash64("lang", "text"))
    sizes = stored(labelled.select("lang", "hash").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    quota = max(LANGUAGE_ROWS, sample_rows // max(1, sizes.count()))
    place = F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53))
    chosen = labelled.join(F.broadcast(sizes), "lang").filter(place * F.col("n") < quota)
    return chosen.dropDuplicates(["lang", "hash"]).select("lang", "text")


def fit_text_model(rows: DataFrame, lang: str = "lang", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict:
    """Log-likelihood tables of the languages and of "und", from the sampled labelled texts."""
    sample = sampled(rows, lang, text, sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, one in sums.items():
                at = np.flatnonzero(one)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(one[at])], ["lang", "cell", "n"])
            sums.clear()

        for batch in slices(batches, most=4 << 20):
            b, bucket, counts, starts = _grams(text_of(batch))
            for k, name in enumerate(batch.column(0).to_pylist()):
                if name not in sums and len(sums) == HELD_LANGUAGES:
                    yield from told()
                one = sums.setdefault(name, np.zeros(BUCKETS + 256, np.int64))
                part = slice(starts[k], max(starts[k], min(starts[k + 1], len(bucket))))
                one[:BUCKETS] += np.bincount(bucket[part][counts[part]], minlength=BUCKETS)
                one[BUCKETS:] += np.bincount(b[starts[k] : starts[k + 1]], minlength=256)
        yield from told()

    cells = in_arrow(sample, count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    cells = stored(cells, "grams")
    names = sorted(r.lang for r in cells.filter(F.col("cell") < BUCKETS).select("lang").distinct().collect())
    tables = np.zeros((BUCKETS, len(names) + 1), np.float32)
    single = np.ones(256)
    for first in range(0, len(names), HELD_LANGUAGES):
        held = names[first : first + HELD_LANGUAGES]
        of = dict(list(cells.filter(F.col("lang").isin(held)).toPandas().groupby("lang")))
        for k, name in enumerate(held, first):
            grams = np.zeros(BUCKETS + 256)
            grams[of[name]["cell"]] = of[name]["n"]
            single += grams[BUCKETS:]
            tables[:, k] = np.log((grams[:BUCKETS] + 0.5) / (grams[:BUCKETS].sum() + 0.5 * BUCKETS))
    # letters drawn one by one: the same buckets, from pooled letter counts
    p = single / single.sum()
    common = np.argsort(-p)[:40]
    und = np.full(BUCKETS, 1e-9)
    grid = np.stack(np.meshgrid(*[common] * GRAM, indexing="ij"), -1).reshape(-1, GRAM)
    keep = (grid != 32).sum(1) >= 2
    grid = grid[keep].astype(np.uint32)
    code = (grid[:, 0] << np.uint32(24)) | (grid[:, 1] << np.uint32(16)) | (grid[:, 2] << np.uint32(8)) | grid[:, 3]
    np.add.at(und, (code * np.uint32(2654435761)) >> np.uint32(32 - 15), p[grid].prod(1))
    tables[:, -1] = np.log(und / und.sum() * 0.99 + 0.01 / BUCKETS)
    return {"names": names, "tables": tables}


def text_likelihoods(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` with, instead of ``text``, ``ll``: its log-likelihood under each language and "und", and ``alone``: their
    probabilities with nothing but the text known."""
    keep = [c for c in rows.columns if c != "text"]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["ll array<double>", "alone array<double>"])
    tables = model["tables"]
    n = tables.shape[1]
    start = np.log(np.array([(1 - UND) / max(n - 1, 1)] * (n - 1) + [UND]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = np.ascontiguousarray(tables.T)
        rows_of = max(1, HELD_LIKELIHOODS // n)
        whole = slices(batches, most=4 << 20)
        for batch in (b.slice(k, rows_of) for b in whole for k in range(0, b.num_rows, rows_of)):
            _, bucket, counts, starts = _grams(text_of(batch))
            at = np.concatenate(([0], np.cumsum(counts)))[np.minimum(starts, len(bucket))]
            used = bucket[counts]
            ll = np.zeros((batch.num_rows, len(columns)))
            some = np.flatnonzero(np.diff(at) > 0)
            for k, one in enumerate(columns):
                if len(some):
                    ll[some, k] = np.add.reduceat(one[used], at[some], dtype=np.float64)
            ll /= GRAM
            alone = np.exp(ll + start - (ll + start).max(1, keepdims=True, initial=-np.inf))
            alone /= alone.sum(1, keepdims=True)
            at = pa.array(np.arange(batch.num_rows + 1) * n, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (ll, alone)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], *lists], [*keep, "ll", "alone"])

    return in_arrow(rows, score, schema)


def _sums(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """For each value of ``key`` the sums of ``alone`` as an array ``name``, and the number of rows."""
    each = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(F.col("alone")[k]).alias(f"_{k}") for k in range(n)], F.count(F.lit(1)).alias(f"{name}_rows"))
    return each.select(key, F.array(*[f"_{k}" for k in range(n)]).alias(name), f"{name}_rows")


def identified(rows: DataFrame, model: dict, least: float = LEAST) -> DataFrame:
    """(id, text_hash, language, posterior, rejected) of rows (id, text, markup, suffix, host)."""
    names = [*model["names"], UNKNOWN]
    n = len(names)
    if n == 1:
        return rows.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.lit(UNKNOWN).alias("language"), F.lit(1.0).alias("posterior"), F.lit(False).alias("rejected"))
    evidence = rows.select("id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("markup", "suffix", "host")])
    scored = stored(text_likelihoods(evidence, model), "language")
    whole = scored.agg(*[F.sum(F.col("alone")[k]) for k in range(n)], F.count(F.lit(1))).first()
    base = [((x or 0.0) + 1.0 / n) / (whole[n] + 1.0) for x in whole[:n]]
    declared = _sums(scored, "markup", n, "by_markup")
    made = declared.agg(*[F.sum(F.col("by_markup")[k]) for k in range(n)], F.count(F.lit(1))).first()
    says_all = [(x or 0.0) + DECLARED_START * (made[n] + 1) for x in made[:n]]
    joined = scored.join(_sums(scored, "suffix", n, "by_suffix"), "suffix", "left").join(_sums(scored, "host", n, "by_host"), "host", "left").join(declared, "markup", "left")
    zero = F.lit(0.0)

    def share(sums: str, k: Column, outer: Column) -> Column:
        """Share of language k among the other rows of a group, drawn towards ``outer``."""
        others = F.coalesce(F.get(sums, k) - F.get("alone", k), zero)
        return (F.greatest(others, zero) + DRAW * outer) / (F.coalesce(F.col(f"{sums}_rows") - 1, zero) + DRAW)

    def log_evidence(k: Column) -> Column:
        prior = share("by_host", k, share("by_suffix", k, F.get(F.array(*map(F.lit, base)), k)))
        says = (F.greatest(F.get("by_markup", k) - F.get("alone", k), zero) + DECLARED_START) / F.get(F.array(*map(F.lit, says_all)), k)
        return F.get("ll", k) + F.log(prior) + F.when(F.col("by_markup").isNotNull(), F.log(says)).otherwise(zero)

    logs = joined.withColumn("logs", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), log_evidence))
    top = F.array_max("logs")
    total = F.aggregate("logs", zero, lambda sum_, x: sum_ + F.exp(x - F.array_max("logs")))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("logs", top).cast("int"))
    out = logs.select("id", "text_hash", best.alias("language"), (1 / total).alias("posterior"))
    return out.withColumn("rejected", (F.col("language") == UNKNOWN) | (F.col("posterior") < least))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents have no markup and no address; their source stands for the host."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), none.alias("markup"), none.alias("suffix"), F.col("source").cast("string").alias("host"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Visible text, the ``lang`` of the html tag, the last label of the host name, and the host of raw pages."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    markup = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]+)""", 1))
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), markup.alias("markup"), F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"), host.alias("host"))


def accepted(docs: DataFrame) -> DataFrame:
    """Documents that are not rejected, with their columns; the ``lang`` column labels the text model."""
    judged = identified(document_evidence(docs), fit_text_model(docs))
    gone = judged.filter("rejected").select(F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash"))
    meet = docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == gone["_text_hash"])
    return docs.join(gone, meet, "left_anti")


def op3_evidence_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(document_evidence(docs), fit_text_model(docs)).select(F.col("id").alias("doc_id"), "language", "posterior", "rejected")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for raw pages, whose markup and address speak too; the text model is that of the documents."""
    judged = identified(page_evidence(table(spark, sf_dir, "pages")), fit_text_model(table(spark, sf_dir, "documents")))
    return judged.select(F.col("id").alias("page_id"), "language", "posterior", "rejected")


QUERIES = {"op3_evidence_language": op3_evidence_language, "page_language": page_language}
SQL: dict[str, str] = {}
