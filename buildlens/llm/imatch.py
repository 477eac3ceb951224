"""I-Match fingerprints over several randomised lexicon subsets, with DataFrame functions only.

Terms are runs of letters and digits in lower case. The lexicon holds terms whose inverse document frequency
``ln(documents / documents with the term)`` lies in a band: neither the words of most documents nor the rarest. Each of
``SUBSETS`` sparse subsets keeps a seeded random part of the lexicon, one in ``RATES`` of its terms; these survive edits
of long texts. After them come the ``DENSE`` ones, which tell short texts apart: the whole lexicon, and seeded random parts
of it. A text's terms of a subset, distinct and sorted, are hashed; the hashes, in the order of the subsets, are the
fingerprint. Likeness is the share of equal hashes among the subsets in
which either text has a term.

The lexicon is bounded: a term is in at least ``exp(-HIGH_IDF)`` of all documents, so there are at most (mean distinct
terms of a document) * exp(HIGH_IDF) of them, however large the corpus; it is broadcast while it has no more than
``LEXICON_TERMS``, else joined by term.

Null texts count as empty. A text without lexicon terms has the first digits of its own sha256 in every place. Equal
texts have equal fingerprints. The next document is the next one in descending id (null ids come last, equal ids in the
order of their texts' hashes); after the last comes the first. Other columns are not read. An empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.llm.common import stored, table

LOW_IDF, HIGH_IDF, LEAST_DOCUMENTS = 2.0, 6.5, 2
SUBSETS, RATES, DIGITS = 48, (32, 128, 512), 6
#: Parts of the lexicon that the dense subsets keep.
DENSE = ((1, 1), (2, 3), (2, 3), (1, 2), (1, 2), (1, 4), (1, 4))
PLACES = SUBSETS + len(DENSE)
LEXICON_TERMS = 500_000
#: Subsets whose terms are picked from a text's terms in one go.
TOGETHER = 6
EMPTY = "-" * DIGITS


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(texts: DataFrame) -> DataFrame:
    """(term, mask): terms of the band, and as bits the subsets that keep them."""
    total = texts.count()
    least, most = max(LEAST_DOCUMENTS, total * math.exp(-HIGH_IDF)), max(total * math.exp(-LOW_IDF), LEAST_DOCUMENTS)
    # every text has a term, if only the empty one; an inner explode would split the texts once more to look for none
    counts = texts.select(F.explode_outer(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    # written first: a filter on the masks of an aggregate would be moved below it and make them for every word of every text
    band = stored(counts.filter((F.col("term") != "") & F.col("n").between(least, most)).select("term"), "band")
    mask = F.lit(0).cast("long")
    for k, (part, of) in enumerate([*[(1, RATES[k % len(RATES)]) for k in range(SUBSETS)], *DENSE]):
        kept = F.pmod(F.xxhash64("term", F.lit(k)), F.lit(of)) < part
        mask = mask.bitwiseOR(F.when(kept, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return band.select("term", mask.alias("mask"))


def fingerprint(terms: Column, digest: Column) -> Column:
    """Hashes of the sorted (term, mask) of each subset; ``digest`` stands in for texts without terms."""
    bits = [F.array(*[F.lit(1 << b).cast("long") for b in range(first, min(first + TOGETHER, SUBSETS))]) for first in range(0, SUBSETS, TOGETHER)]

    def of(held: Column, mask: Column) -> Column:
        return F.filter(held, lambda t: t["mask"].bitwiseAND(mask) != 0)

    # arrays of one element, here and below, so that what they hold is worked out once and not for each use
    def one(held: Column, bit: Column) -> Column:
        joined = F.concat_ws(" ", F.transform(of(held, bit), lambda t: t["term"]))
        return F.transform(F.array(joined), lambda own: F.when(own == "", F.lit(EMPTY)).otherwise(F.substring(F.md5(own.cast("binary")), 1, DIGITS)))[0]

    def together(held: Column, k: int) -> Column:
        """Hashes of neighbouring subsets: few terms are in any of them, and only these are looked through for each."""
        mask = sum(1 << b for b in range(k * TOGETHER, min((k + 1) * TOGETHER, SUBSETS)))
        return F.transform(F.array(of(held, F.lit(mask).cast("long"))), lambda few: F.transform(bits[k], lambda bit: one(few, bit)))[0]

    def sparse(held: Column) -> Column:
        some = of(held, F.lit((1 << SUBSETS) - 1).cast("long"))
        return F.transform(F.array(some), lambda some: F.concat(*[together(some, k) for k in range(len(bits))]))[0]

    dense = F.array(*[F.lit(1 << b).cast("long") for b in range(SUBSETS, PLACES)])
    hashes = F.transform(F.array(F.sort_array(terms)), lambda held: F.concat(sparse(held), F.transform(dense, lambda bit: one(held, bit))))[0]
    return F.when(F.size(terms) == 0, F.array_repeat(F.substring(digest, 1, DIGITS), PLACES)).otherwise(hashes)


def likeness(a: Column, b: Column) -> Column:
    said = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY))
    same = F.filter(said, lambda p: p["a"] == p["b"])
    return F.size(same) / F.greatest(F.size(said), F.lit(1))


def following(rows: DataFrame, column: str, order: list[Column], top: Column) -> DataFrame:
    """``next``: the column's value in the next row of the order (bin descending, order); after the last, the first.

    Inside a bin a window finds it; a bin's last row takes the first row of the next bin that has rows.
    """
    inside = Window.partitionBy("bin").orderBy(*order)
    heads = rows.groupBy("bin").agg(F.max_by(F.struct(F.col(column).alias("head")), top)["head"].alias("head"))
    turn = Window.orderBy(F.desc("bin"))  # one row a bin, whose number is fixed
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("bin").alias("_bin"), F.coalesce(F.lead("head").over(turn), F.first("head").over(whole)).alias("_head"))
    with_next = rows.withColumn("next", F.lead(column).over(inside))
    return with_next.join(heads, F.col("bin") == F.col("_bin")).withColumn("next", F.coalesce("next", "_head")).drop("_bin", "_head")


def binned(docs: DataFrame) -> DataFrame:
    """(bin, doc_id, text): ids dealt to a fixed number of bins by quantiles; the null id is in the lowest."""
    spark = docs.sparkSession
    n = max(32, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] or []
    cut = F.array(*[F.lit(int(b)) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<bigint>")
    return rows.withColumn("bin", F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(cut, lambda b: b < F.col("doc_id")))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    rows = binned(docs).withColumn("text_hash", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("text_hash")]
    top = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), (-F.col("text_hash")).alias("turned"))
    texts = following(rows, "text", order, top)
    taken = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - taken), F.substring(F.col("next"), F.lit(1), taken))
    place = F.row_number().over(Window.partitionBy("bin").orderBy(*order))
    texts = texts.select(
        "bin", place.alias("place"), "doc_id", "text_hash", "text", edited.alias("edited"), F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
    )
    words = lexicon(rows.select("text"))
    words = stored(words, "lexicon")
    if words.count() <= LEXICON_TERMS:
        words = F.broadcast(words)

    # words travel with their text's place alone; the text's own columns are in one more row, which also keeps texts without terms
    row = F.struct("doc_id", "text_hash", "n_chars", "sha256", "edited_sha256")
    mark = F.array(F.struct(F.lit(2).alias("side"), F.concat(F.lit(" "), "place").alias("term"), row.alias("row")))

    def side(k: int, column: str) -> Column:
        return F.transform(terms_of(F.col(column)), lambda t: F.struct(F.lit(k).alias("side"), t.alias("term"), F.when(F.lit(False), row).alias("row")))

    each = texts.select("bin", "place", F.explode_outer(F.concat(mark, side(0, "text"), side(1, "edited"))).alias("t")).select("bin", "place", "t.*")
    met = each.join(words, "term", "left").filter((F.col("side") == 2) | F.col("mask").isNotNull())
    term = F.struct("term", "mask")
    met = met.groupBy("bin", "place").agg(F.first("row", True).alias("row"), *[F.collect_list(F.when(F.col("side") == k, term)).alias(f"terms{k}") for k in (0, 1)])
    met = met.select("bin", "row.*", "terms0", "terms1")
    done = met.select(
        "bin", "doc_id", "text_hash", "n_chars", "edited_sha256", fingerprint(F.col("terms0"), F.col("sha256")).alias("own"), fingerprint(F.col("terms1"), F.col("edited_sha256")).alias("edited")
    )
    done = following(stored(done, "imatch"), "own", order, top)
    return done.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("own", "").alias("fingerprint"), F.array_join("edited", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op8_imatch": op8_imatch}
SQL: dict[str, str] = {}
