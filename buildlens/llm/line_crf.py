"""Quality of documents by a linear-chain conditional random field over their lines.

Each line is good or bad. Features are shares of letters, capitals, digits and symbols, lengths, repeated words and line
shape, of the line and of both neighbours; one weight for each pair of neighbouring labels links the chain. Weights are
fitted by gradient ascent on the lines of a bounded sample of labelled documents: lines start with their document's
label, and lines of bad documents that the fitted chain finds good are relabelled once. Forward-backward marginals of
good, weighted by the lines' lengths, make the document's figure, and one logistic curve, fitted to the labels of the
same sample, turns figures into scores.

Scores use the text alone. Null and empty texts are one empty line. Repeated rows score alike. With no labelled rows, or
rows of one label only, every score is the share of label 1 (0.5 with none). Labels that are null or neither 0 nor 1
are ignored; of several labels of one document the smallest holds. Extra columns are kept by ``good_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import free_name, in_arrow, slices, table, text_of, words_of

#: Labelled documents that the model is fitted on at most; lines of a chain in fitting (longer documents are cut).
SAMPLE_DOCUMENTS, CHAIN_LINES = 4_000, 256
STEPS, RATE, DECAY = 120, 0.15, 1e-3
#: Features of one line, and those of the neighbours that a line sees too.
OWN = ["bias", "capitals", "digits", "symbols", "odd symbols", "words", "word length", "same word again", "repeated words", "ends a sentence", "empty"]
NEIGHBOURS = [1, 3, 4, 7, 8]

# byte classes: 1 lower letter or part of another script, 2 capital, 3 digit, 4 common punctuation, 5 other symbol
CLASSES = np.zeros(256, np.uint8)
CLASSES[ord("a") : ord("z") + 1] = 1
CLASSES[128:] = 1
CLASSES[ord("A") : ord("Z") + 1] = 2
CLASSES[ord("0") : ord("9") + 1] = 3
CLASSES[33:48] = CLASSES[58:65] = CLASSES[91:97] = CLASSES[123:127] = 5
CLASSES[[ord(c) for c in ".,;:'\"?!()-"]] = 4


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and where each text's lines start (with the end of the last)."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    starts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    n = len(lines)
    raw = lines.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kinds = CLASSES[data]
    counts = np.zeros((6, n))
    for k in range(1, 6):
        counts[k] = np.diff(np.concatenate(([0], np.cumsum(kinds == k, dtype=np.int32)))[ends])
    size = np.diff(ends)
    seen = np.maximum(counts[1:].sum(0), 1)
    letters = np.maximum(counts[1] + counts[2], 1)
    codes, word_starts, words = words_of(lines)
    per_line = np.diff(word_starts)
    line = np.repeat(np.arange(n), per_line)
    again = np.zeros(len(codes))
    again[1:] = (codes[1:] == codes[:-1]) & (line[1:] == line[:-1])
    n_words = np.maximum(per_line, 1)
    distinct = np.bincount(np.unique(line * max(len(words), 1) + codes) // max(len(words), 1), minlength=n)
    last = np.zeros(n, np.uint8)
    last[size > 0] = data[ends[1:][size > 0] - 1]
    own = np.stack(
        [
            np.ones(n),
            counts[2] / letters,
            counts[3] / seen,
            (counts[4] + counts[5]) / seen,
            counts[5] / seen,
            np.log1p(per_line) / 5,
            np.minimum(letters / n_words, 20) / 10,
            np.bincount(line, again, n) / n_words,
            1 - distinct / n_words * (per_line > 0) - (per_line == 0),
            np.isin(last, [ord(c) for c in ".?!:\"'"]),
            size == 0,
        ],
        1,
    )
    side = own[:, NEIGHBOURS]
    before, after = np.zeros_like(side), np.zeros_like(side)
    before[1:], after[:-1] = side[:-1], side[1:]
    before[starts[:-1]] = 0  # a text has no line before its first, nor after its last
    after[starts[1:] - 1] = 0
    return np.hstack([own, before, after]), size.astype(float), starts


def _ordered(starts: np.ndarray) -> list[np.ndarray]:
    """Places of the t-th lines of all chains that have one, longest chains first, for t = 0, 1, ..."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = starts[:-1][order], sizes[order]
    live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")
    return [first[:k] + t for t, k in enumerate(live)]


def _logadd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(unary: np.ndarray, link: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each line's labels (bad, good), and expected counts of neighbouring label pairs."""
    forward, backward = unary.copy(), np.zeros_like(unary)
    for a, b in zip(steps[:-1], steps[1:]):
        x = forward[a[: len(b)], :, None] + link
        forward[b] += _logadd(x[:, 0], x[:, 1])
    pairs = np.zeros((2, 2))
    for a, b in zip(steps[-2::-1], steps[:0:-1]):
        a = a[: len(b)]
        x = link + (unary[b] + backward[b])[:, None, :]
        backward[a] = _logadd(x[:, :, 0], x[:, :, 1])
        both = forward[a][:, :, None] + x
        top = both.max((1, 2), keepdims=True)
        p = np.exp(both - top)
        pairs += (p / p.sum((1, 2), keepdims=True)).sum(0)
    joint = forward + backward
    joint -= joint.max(1, keepdims=True, initial=-np.inf)
    p = np.exp(joint)
    return p / p.sum(1, keepdims=True), pairs


def _fit_chain(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> dict:
    """Weights that make the labels ``y`` (1: good) likely; Adam steps on the mean log-likelihood of a line."""
    steps, n = _ordered(starts), len(x)
    first = np.zeros(n, bool)
    first[starts[:-1]] = True
    seen = np.zeros((2, 2))
    later = np.flatnonzero(~first)
    np.add.at(seen, (y[later - 1], y[later]), 1)
    weights, link = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    one = np.eye(2)[y]
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (weights, link)]
    for step in range(1, STEPS + 1):
        p, pairs = marginals(x @ weights, link, steps)
        for w, g, (m, v) in zip((weights, link), (x.T @ (one - p) / n, (seen - pairs) / n), state):
            g = g - DECAY * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"weights": weights, "link": link}


def _figures(x: np.ndarray, size: np.ndarray, starts: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Length-weighted mean of the marginals of good for each chain, and the marginals."""
    p, _ = marginals(x @ model["weights"], model["link"], _ordered(starts))
    weight = size + 1.0
    mean = np.add.reduceat(weight * p[:, 1], starts[:-1]) / np.add.reduceat(weight, starts[:-1])
    return mean, p[:, 1]


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE_DOCUMENTS) -> dict:
    """The model, from at most ``most`` of the rows (doc_id, label) of ``labelled``, chosen by a hash of the id."""
    held = labelled.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3 << 20):
            x, size, starts = line_features(text_of(batch))
            rows = [np.hstack([x[a:b], size[a:b, None]]).astype("<f4").tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "label", "lines"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    # at most ``most`` ids and labels, so the smaller side has a fixed bound
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = in_arrow(sample, features, "doc_id long, label int, lines binary").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    labels = np.array([r["label"] for r in rows], int)
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return {"share": share}
    width = len(OWN) + 2 * len(NEIGHBOURS) + 1
    each = [np.frombuffer(r["lines"], "<f4").reshape(-1, width).astype(float) for r in rows]
    x, size = np.vstack(each)[:, :-1], np.concatenate([e[:, -1] for e in each])
    doc_starts = np.concatenate(([0], np.cumsum([len(e) for e in each])))
    cuts = np.concatenate([np.arange(a, b, CHAIN_LINES) for a, b in zip(doc_starts[:-1], doc_starts[1:])] + [doc_starts[-1:]])
    y = np.repeat(labels, np.diff(doc_starts))
    model = _fit_chain(x, y, cuts)
    _, good = _figures(x, size, doc_starts, model)
    model = _fit_chain(x, np.where((y == 0) & (good > 0.5), 1, y), cuts)
    mean, _ = _figures(x, size, doc_starts, model)
    # one logistic curve on the figure, by Newton steps with a little shrinkage
    z = np.stack([np.ones(len(mean)), _logit(mean)], 1)
    curve = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        curve += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), z.T @ (labels - p) - 0.1 * curve)
    return model | {"share": share, "curve": curve}


def scored(docs: DataFrame, model: dict, column: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of every whole text."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{column}` double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3 << 20):
            if "curve" in model:
                x, size, starts = line_features(text_of(batch))
                mean, _ = _figures(x, size, starts, model)
                got = 1 / (1 + np.exp(-np.clip(model["curve"][0] + model["curve"][1] * _logit(mean), -30, 30)))
            else:
                got = np.full(batch.num_rows, model["share"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, column])

    return in_arrow(docs, score, schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of the documents that may be learned from."""
    return labels.filter(~held_out()).select(F.col("doc_id").cast("long"), F.col("quality").alias("label"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score 0.5 or more, with their columns."""
    name = free_name(docs, "quality_score")
    return scored(docs, fit(docs, training_labels(labels)), name).filter(F.col(name) >= 0.5).drop(name)


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, fit(docs, training_labels(table(spark, sf_dir, "labels"))), "score")
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_line_crf": op9_line_crf}
SQL: dict[str, str] = {}
