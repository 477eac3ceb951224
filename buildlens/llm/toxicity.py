"""Toxicity of documents by boosted trees over dense features, with isotonic calibration.

1. A bounded sample of labelled documents is drawn for each label. Over it, every word and every stem (the first
   ``STEMS`` letters) is counted by label; those that toxic documents hold more often than chance allows make the
   lexicon, each with its log-odds. A labelled document's own features come from a lexicon counted without its part of
   the sample, so that rare words do not give its label away.
2. Features of a text: densities, counts and weights of lexicon words and stems, lexicon words near a second person,
   capitals, punctuation, and rates of hidden words (signs for letters, signs within, letters drawn out), with the lexicon
   words that appear once these are undone.
3. Gradient-boosted trees (Spark ML) are fitted to all parts of the sample but one; an isotonic curve, fitted to the last part,
   turns their margin into a probability. Rows weigh what their label's share of all labelled documents says.

Scores use the text alone. Null and empty texts have no words and get a score like any text. Equal texts score alike, and
fall in one part of the sample. Labels that are null or neither 0 nor 1 are ignored; of several labels of one document
the smallest holds, of several texts of one labelled id one. With no labelled documents, or of one label only, every
score is the share of label 1 (0.5 with none). Empty tables give empty results. Columns of the input are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import free_name, in_arrow, slices, stored, table, text_of, words_of

#: Labelled documents of each label that the model is fitted on at most, and lexicon terms at most (the surest ones).
SAMPLE_TOXIC, SAMPLE_CLEAN, LEXICON_TERMS = 4_000, 8_000, 20_000
#: Letters of a stem; parts of the sample; toxic documents that hold a lexicon term, and how sure its log-odds are, at least.
STEMS, PARTS, LEAST_DOCUMENTS, LEAST_Z = (3, 4, 5, 6, 7), 4, 3, 3.0
TREES, DEPTH, STEP = 30, 3, 0.25
#: Words between a lexicon word and a second person that count as near.
NEAR = 4

# Second persons of the languages in the tables, and signs that stand for letters.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su sus vos".split()
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

FEATURES = [
    "words", "lexicon density", "lexicon count", "lexicon weight", "largest weight", "distinct lexicon words", "stem density", "stem count",
    "largest stem weight", "second person density", "lexicon near second person", "capitals", "words in capitals", "exclamations", "questions",
    "signs", "digits", "hidden words", "hidden lexicon words", "drawn-out words", "single letters", "same word again",
]


def cores(words: pa.Array) -> pa.Array:
    """Words in lower case without the punctuation at their ends."""
    return pc.utf8_lower(pc.ascii_trim(words, characters=PUNCTUATION))


def stems(core: pa.Array) -> list[pa.Array]:
    """For each stem length the core's first letters and a star; null for shorter cores."""
    size = pc.utf8_length(core)
    none = pa.scalar(None, pa.string())
    return [pc.if_else(pc.greater_equal(size, n), pc.binary_join_element_wise(pc.utf8_slice_codeunits(core, 0, n), "*", ""), none) for n in STEMS]


class Lexicon:
    """Terms with their log-odds."""

    def __init__(self, weights: dict[str, float]):
        self.terms = pa.array(list(weights), pa.string())
        self.weights = np.array([*weights.values(), 0.0])

    def of(self, terms: pa.Array) -> np.ndarray:
        at = pc.index_in(terms, value_set=self.terms, skip_nulls=True)
        return self.weights[pc.fill_null(at, -1).to_numpy(zero_copy_only=False)]


def undone(word: str) -> str:
    """A hidden word's letters: signs for letters read as such, others within left out, drawn-out letters once."""
    letters = "".join(SIGNS.get(c, c) for c in word.strip(".,;:?\"'()"))
    return re.sub(r"(.)\1{2,}", r"\1", re.sub(r"[\W\d_]+", "", letters.lower()))


def _byte_counts(words: pa.Array) -> dict[str, np.ndarray]:
    """Letters, capitals, digits, signs and the like of each word, from its bytes."""
    n = len(words)
    raw = pa.concat_arrays([words]).cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[ends])

    capital = (data >= 65) & (data <= 90)
    letter = capital | ((data >= 97) & (data <= 122)) | (data >= 0xC0)
    digit = (data >= 48) & (data <= 57)
    sign = ~letter & ~digit & (data > 32) & (data < 128)
    drawn = np.zeros(len(data), bool)
    drawn[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    word = np.repeat(np.arange(n), np.diff(ends))
    drawn[2:] &= word[2:] == word[:-2]
    inner = np.zeros(len(data), bool)
    before = np.zeros(len(data), bool)
    before[1:] = letter[:-1] & (word[1:] == word[:-1])
    inner[:-1] = (sign | digit)[:-1] & letter[1:] & (word[:-1] == word[1:]) & (before | np.isin(data, [ord(c) for c in SIGNS]))[:-1]
    masks = {"letters": letter, "capitals": capital, "digits": digit, "signs": sign, "exclamations": data == 33, "questions": data == 63, "drawn": drawn, "inner": inner}
    return {k: per_word(m).astype(float) for k, m in masks.items()}


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    codes, starts, words = words_of(texts)
    rows, n = len(starts) - 1, np.diff(starts).astype(float)
    core = cores(words)
    bytes_of = _byte_counts(words)
    weight = lexicon.of(core)
    stem = np.max([lexicon.of(s) for s in stems(core)] or [np.zeros(len(words))], axis=0) if len(words) else weight
    hidden = ((bytes_of["inner"] > 0) | (bytes_of["drawn"] > 0)) & (bytes_of["letters"] > 1)
    unhidden = np.zeros(len(words))
    some = np.flatnonzero(hidden)
    if len(some):
        plain = pa.array([undone(w) for w in words.take(pa.array(some)).to_pylist()], pa.string())
        found = lexicon.of(plain)
        unhidden[some] = np.where(weight[some] > 0, 0, found)
    second = pc.is_in(core, value_set=pa.array(SECOND_PERSON)).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(rows), np.diff(starts))

    def total(per_word: np.ndarray) -> np.ndarray:
        return np.bincount(text, per_word[codes].astype(float), rows)

    def largest(per_word: np.ndarray) -> np.ndarray:
        out = np.zeros(rows)
        np.maximum.at(out, text, per_word[codes])
        return out

    strong = np.maximum(weight, unhidden)
    hit = strong > 0
    pairs = np.unique(text[hit[codes]] * max(len(words), 1) + codes[hit[codes]])
    # words from each second person to the next lexicon word and back, within a text
    near = np.zeros(len(codes), bool)
    at_second, at_hit = second[codes], hit[codes]
    for d in range(1, NEAR + 1):
        same = text[d:] == text[:-d]
        near[d:] |= at_hit[d:] & at_second[:-d] & same
        near[:-d] |= at_hit[:-d] & at_second[d:] & same
    again = np.zeros(len(codes))
    again[1:] = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
    per, letters = np.maximum(n, 1), np.maximum(total(bytes_of["letters"]), 1)
    hits, stem_hits = total(hit), total(stem > 0)
    in_capitals = (bytes_of["capitals"] == bytes_of["letters"]) & (bytes_of["letters"] > 1)
    return np.stack(
        [
            np.log1p(n), hits / per, np.log1p(hits), total(strong) / per, largest(strong), np.log1p(np.bincount(pairs // max(len(words), 1), minlength=rows)),
            stem_hits / per, np.log1p(stem_hits), largest(stem), total(second) / per, np.bincount(text, near, rows) / per, total(bytes_of["capitals"]) / letters,
            total(in_capitals) / per, total(bytes_of["exclamations"]) / per, total(bytes_of["questions"]) / per, total(bytes_of["signs"]) / letters,
            total(bytes_of["digits"]) / letters, total(hidden) / per, total(unhidden > 0) / per, total(bytes_of["drawn"] > 0) / per,
            total((bytes_of["letters"] == 1) & (bytes_of["digits"] == 0)) / per, np.bincount(text, again, rows) / per,
        ],
        1,
    )


def sample(docs: DataFrame, labelled: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label, part, weight) of the sample, and the number of labelled documents of each label."""
    held = labelled.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    sizes = {r.label: r.n for r in held.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {0: clean, 1: toxic}
    chosen = None
    for label in (0, 1):
        rows = held.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[label])
        rows = rows.withColumn("weight", F.lit(sizes.get(label, 0) / max(min(sizes.get(label, 0), most[label]), 1)))
        chosen = rows if chosen is None else chosen.union(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the ids of the sample have a fixed bound; one text of each, the one of the smallest hash
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("_hash", F.xxhash64("text"))
    rows = rows.groupBy("doc_id", "label", "weight").agg(F.min_by("text", "_hash").alias("text"), F.min("_hash").alias("_hash"))
    return rows.select("doc_id", "text", "label", F.pmod(F.col("_hash"), F.lit(PARTS)).cast("int").alias("part"), "weight"), sizes


def lexicons(rows: DataFrame) -> list[Lexicon]:
    """A lexicon counted without each part of the sample, and last the one of all parts."""
    width = 2 * PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3 << 20):
            codes, starts, words = words_of(text_of(batch))
            core = cores(words)
            terms = [core, *stems(core)]
            coded = pa.chunked_array(terms).combine_chunks().dictionary_encode()
            of_word = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).reshape(len(terms), len(words))
            text = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            names = max(len(coded.dictionary), 1)
            pairs = np.unique(np.concatenate([text[of_word[k][codes] >= 0] * names + of_word[k][codes][of_word[k][codes] >= 0] for k in range(len(terms))]))
            label, part = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("label", "part"))
            cell = (label * PARTS + part)[pairs // names].astype(np.int64)
            found, times = np.unique(pairs % names * width + cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(found // width)), pa.array(found % width), pa.array(times)], ["term", "cell", "n"])

    got = in_arrow(rows.select("text", "label", "part"), count, "term string, cell long, n long").filter("term <> ''")
    sizes = {(r.label, r.part): r.n for r in rows.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = got.groupBy("term").agg(*[F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(width)])
    without = [{PARTS * label + p: sizes.get((label, p), 0) for label in (0, 1) for p in range(PARTS) if p != out} for out in [*range(PARTS), None]]

    def odds(parts: dict[int, int]):
        counts, rates = [], []
        for label in (0, 1):
            own = [k for k in parts if k // PARTS == label]
            n = sum((F.col(f"n{k}") for k in own), F.lit(0)) + 0.5
            counts.append(n)
            rates.append(F.log(n / (sum(parts[k] for k in own) + 1)))
        w = rates[1] - rates[0]
        return w, w / F.sqrt(1 / counts[0] + 1 / counts[1]), counts[1]

    each = [odds(p) for p in without]
    sure = [F.when((z >= LEAST_Z) & (toxic >= LEAST_DOCUMENTS), w) for w, z, toxic in each]
    best = cells.select("term", each[-1][1].alias("z"), *[w.alias(f"w{k}") for k, w in enumerate(sure)])
    best = best.filter(F.coalesce(*[F.col(f"w{k}") for k in range(PARTS + 1)]).isNotNull()).orderBy(F.col("z").desc(), "term").limit(LEXICON_TERMS).collect()
    return [Lexicon({r.term: r[f"w{k}"] for r in best if r[f"w{k}"] is not None}) for k in range(PARTS + 1)]


def fit(docs: DataFrame, labelled: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> dict:
    """The model, from a bounded sample of the rows (doc_id, label) of ``labelled``."""
    rows, sizes = sample(docs, labelled, toxic, clean)
    rows = stored(rows, "toxicity-sample")
    found = {r.label for r in rows.select("label").distinct().collect()}
    if len(found) < 2:
        return {"share": 1.0 if found == {1} else 0.0 if found == {0} else 0.5}
    each = lexicons(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3 << 20):
            part = batch.column(batch.schema.get_field_index("part")).to_numpy(zero_copy_only=False)
            for p in np.unique(part).tolist():
                own = batch.filter(pa.array(part == p))
                x = features(text_of(own), each[p])
                yield pa.RecordBatch.from_arrays([*own.select(["label", "part", "weight"]).columns, pa.array(list(x), pa.list_(pa.float64()))], ["label", "part", "weight", "x"])

    measured = in_arrow(rows.select("text", "label", "part", "weight"), measure, "label int, part int, weight double, x array<double>")
    measured = stored(measured.select(F.col("label").cast("double").alias("label"), "part", "weight", "x"), "toxicity-features")
    vectors = measured.select("label", "part", "weight", array_to_vector("x").alias("features")).coalesce(4)
    last = [r.label for r in measured.filter(F.col("part") == PARTS - 1).select("label").distinct().collect()]
    parted = len(last) == 2 and measured.filter(F.col("part") < PARTS - 1).select("label").distinct().count() == 2
    trained, curved = (vectors.filter(F.col("part") < PARTS - 1), vectors.filter(F.col("part") == PARTS - 1)) if parted else (vectors, vectors)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, weightCol="weight", seed=11, maxBins=64, minInstancesPerNode=5).fit(trained)
    margins = trees.transform(curved).select("label", "weight", F.round(_margin(), 2).alias("margin"))
    # equal margins weigh as one, so that the curve is fitted to no more rows than there are hundredths
    grouped = margins.groupBy("margin").agg(F.sum("weight").alias("weight"), (F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("label"))
    curve = IsotonicRegression(featuresCol="margin", weightCol="weight").fit(grouped)
    return {"lexicon": each[-1], "trees": trees, "curve": curve}


def _margin():
    return vector_to_array("rawPrediction")[1]


def scored(docs: DataFrame, model: dict, column: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 of every whole text; an input column of that name is replaced."""
    docs = docs.drop(column)
    if "trees" not in model:
        return docs.withColumn(column, F.lit(model["share"]))
    names = docs.columns
    x = free_name(docs, "features")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{x}` array<double>"])
    lexicon = model["lexicon"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(features(text_of(batch), lexicon)), pa.list_(pa.float64()))], [*names, x])

    own = F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row")
    rows = in_arrow(docs, measure, schema).select(own, array_to_vector(x).alias("features"))
    rows = model["trees"].transform(rows).select("_row", F.round(_margin(), 2).alias("margin"))
    rows = model["curve"].transform(rows)
    return rows.select("_row.*", F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)).alias(column))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of the documents that may be learned from."""
    return labels.filter(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, fit(docs, training_labels(table(spark, sf_dir, "labels"))), "score")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op11_toxicity": op11_toxicity}
SQL: dict[str, str] = {}
