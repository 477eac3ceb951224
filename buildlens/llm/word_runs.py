"""Periodic runs of words, found over tiles of each scale.

A run is a stretch of consecutive words with smallest period q and a length of at least max(LEAST, 2 * q) that no
neighbouring word extends. Periods are taken by octaves [P, 2P):

1. Each document is exploded into overlapping tiles per octave, at least ``TILE`` times P words long; any stretch that is
   long enough for a run lies in some tile. A run repeats a block of about P / 2 words that starts at a multiple of the
   block's length, so tiles in which no such block comes again after a primitive period hold no run and aren't sent.
2. Tiles are dealt by (document, octave, offset) and solved on their own: each block start is a boundary, and the
   boundary's Z-functions, forwards and backwards, tell how far words a period apart agree on both sides of it.
   Z-values come from prefix hashes, for all boundaries and periods at once; the stretches that they give are then
   compared word by word.
3. The fragments are shuffled by (document, period). Two fragments that share a period's length of words are one run.

Words stand between ASCII white space; null texts have none. Rows are documents of their own, whatever their ids.
Empty tables give empty results. A long text travels as tiles; only its own runs meet in one row. Columns of the input
are kept, but for columns called like those that are added, which are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.llm.common import free_name, in_arrow, mixed, slices, stored, table, text_of, word_hashes, words_of

#: Words of a run at least; periods of an octave's lower end that a tile is long, and its words at least.
LEAST, TILE, TILE_WORDS = 12, 16, 4096
#: Cells of one comparison of blocks, so that texts of one repeated word stay small in memory.
CELLS = 1 << 22
BASE = 0x9E3779B97F4A7C15
RUN = "struct<start:long,length:long,period:long>"

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(n, 2).bit_length()
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = _powers[-2:]
    return _powers[0][:n], _powers[1][:n]


class Words:
    """A sequence of numbers with hashes of its stretches."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * self.up[: self.n], out=self.sums[1:])

    def blocks(self, m: int) -> np.ndarray:
        """Hash of the ``m`` numbers from each place on."""
        return (self.sums[m:] - self.sums[: self.n + 1 - m]) * self.down[: self.n + 1 - m]

    def equal(self, x: np.ndarray, apart: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether the ``k`` numbers at ``x`` are those at ``x + apart``, by their hashes."""
        y = x + apart
        return (self.sums[x + k] - self.sums[x]) * self.up[apart] == self.sums[y + k] - self.sums[y]

    def z_forward(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Z-values of the boundaries ``x``: how many numbers from x on equal those ``p`` later."""
        low, high = np.zeros(len(x), np.int64), self.n - x - p
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            fits = self.equal(x, p, mid)
            low, high = np.where(open_ & fits, mid, low), np.where(open_ & ~fits, mid - 1, high)
        return low

    def z_backward(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How many numbers before x equal those ``p`` later."""
        low, high = np.zeros(len(x), np.int64), x.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            fits = self.equal(x - mid, p, mid)
            low, high = np.where(open_ & fits, mid, low), np.where(open_ & ~fits, mid - 1, high)
        return low


def smallest_factors(n: int) -> np.ndarray:
    """Smallest prime factor of each number below ``n``."""
    least = np.arange(n)
    for r in range(2, int(n**0.5) + 1):
        if least[r] == r:
            least[r * r :: r] = np.where(least[r * r :: r] == np.arange(r * r, n, r), r, least[r * r :: r])
    return least


def block_words(octave: int, least: int = LEAST) -> int:
    """Words of a block: the shortest stretch of agreeing words that a run of the octave has holds one whole."""
    stretch = min(max(q, least - q) for q in range(octave, min(2 * octave, max(octave, least) + 1)))
    return (stretch + 1) // 2


def boundaries(words: Words, octave: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, int]:
    """(place, period) of all blocks that come again a period of the octave later, where that period is primitive."""
    m = block_words(octave, least)
    n = words.n
    count = max((n - m - octave) // m + 1, 0)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), m
    hashes = np.concatenate([words.blocks(m), np.zeros(2 * octave, np.uint64)])
    factors = smallest_factors(2 * octave)
    rows = max(CELLS // octave, 1)
    xs, ps = [], []
    for begin in range(0, count, rows):
        k = min(rows, count - begin)
        later = np.lib.stride_tricks.as_strided(hashes[begin * m + octave :], (k, octave), (8 * m, 8))
        row, col = np.nonzero(later == hashes[begin * m : (begin + k) * m : m, None])
        x, p = (row + begin) * m, col + octave
        inside = x + p + m <= n
        x, p = x[inside], p[inside]
        # a divisor d of p that is a period of the words from x to x + p + m is one of the whole run
        rest = p.copy()
        while (rest > 1).any():
            prime = factors[rest]
            d = p // np.maximum(prime, 1)
            short = (rest > 1) & words.equal(x, np.where(rest > 1, d, 0), np.where(rest > 1, p + m - d, 0))
            x, p, rest, prime = x[~short], p[~short], rest[~short], prime[~short]
            while (again := (rest > 1) & (rest % np.maximum(prime, 1) == 0)).any():
                rest = np.where(again, rest // np.maximum(prime, 1), rest)
        xs.append(x)
        ps.append(p)
    return np.concatenate(xs), np.concatenate(ps), m


def solved(values: np.ndarray, octave: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of the octave's periods in a sequence."""
    words = Words(values)
    x, p, m = boundaries(words, octave, least)
    order = np.lexsort((x, p))
    x, p = x[order], p[order]
    first = np.ones(len(x), bool)
    first[1:] = (p[1:] != p[:-1]) | (x[1:] != x[:-1] + m)  # later blocks of a stretch lead to the same run
    x, p = x[first], p[first]
    start = x - words.z_backward(x, p)
    end = x + p + words.z_forward(x, p)
    found = {(int(s), int(e), int(q)): int(b) for s, e, q, b in zip(start, end, p, x) if e - s >= max(least, 2 * q)}
    runs = set()
    for (s, e, q), b in found.items():
        if not np.array_equal(values[s : e - q], values[s + q : e]):  # the hashes of two stretches were equal, not their words
            same = values[: len(values) - q] == values[q:]
            left, right = np.flatnonzero(~same[:b]), np.flatnonzero(~same[b:])
            s = int(left[-1]) + 1 if len(left) else 0
            e = (b + int(right[0]) if len(right) else len(same)) + q
            if e - s < max(least, 2 * q):
                continue
        runs.add((s, e, q))
    return sorted(runs)


def _joined(codes: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' words one after the other with a number of its own after each row, and where each row starts."""
    sizes = starts[rows + 1] - starts[rows]
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.empty(at[-1], np.int64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    take = np.arange(int(sizes.sum())) + np.repeat(starts[rows] - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes)
    out[inside] = codes[take]
    out[~inside] = -1 - np.arange(len(rows))
    return out, at


def _spread(codes: np.ndarray) -> np.ndarray:
    return mixed(codes.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))


def tiles(codes: np.ndarray, starts: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row, octave, offset, words) of the tiles that can hold a run."""
    sizes = np.diff(starts)
    octave = 1
    while 2 * octave <= (sizes.max() if len(sizes) else 0):
        rows = np.flatnonzero(sizes >= max(least, 2 * octave))
        if len(rows):
            flat, at = _joined(codes, starts, rows)
            x, p, m = boundaries(Words(_spread(flat)), octave, least)
            row = np.searchsorted(at, x, "right") - 1
            x = x - at[row]
            size = max(TILE * octave, TILE_WORDS)
            stride = size - max(4 * octave, least)
            low, high = np.maximum(-((size - x - p - m) // stride), 0), x // stride
            meet = [np.stack([row, low + k], 1)[low + k <= high] for k in range(int((high - low).max(initial=-1)) + 1)]
            some = np.unique(np.concatenate([*meet, np.zeros((0, 2), np.int64)]), axis=0)
            for r, k in some.tolist():
                a = int(starts[rows[r]]) + k * stride
                yield int(rows[r]), octave, k * stride, codes[a : min(a + size, int(starts[rows[r] + 1]))]
        octave *= 2


def _packed(words: np.ndarray) -> bytes:
    """Words as small numbers: a byte that says how wide they are, and the numbers."""
    names, own = np.unique(words, return_inverse=True)
    return (b"\2" + own.astype("<u2").tobytes()) if len(names) <= 1 << 16 else (b"\4" + own.astype("<u4").tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def with_runs(docs: DataFrame, least: int = LEAST, digest: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``: the words
    that no run holds after its first period, joined by one space.

    With ``digest``, ``collapsed`` is the SHA-256 of that text and ``text`` goes, so that texts without a run are in no file.
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    names = docs.columns
    key, octave, offset, packed = (free_name(docs, n) for n in ("key", "octave", "offset", "packed"))
    keyed = docs.withColumn(key, F.monotonically_increasing_id())
    at_text = names.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3 << 20):
            texts = text_of(batch)
            codes, starts, distinct = words_of(texts)
            words = distinct.to_pylist()
            found = list(tiles(codes.astype(np.int64), starts, least))
            held = np.zeros(batch.num_rows, bool)
            held[[f[0] for f in found]] = True
            own = [batch.column(k) for k in range(len(names))]
            collapsed = [None if h else " ".join([words[c] for c in codes[a:b]]) for h, a, b in zip(held, starts[:-1], starts[1:])]
            if digest:
                collapsed = [c if c is None else _sha256(c) for c in collapsed]
                own[at_text] = pa.array([t if h else None for t, h in zip(texts.to_pylist(), held)], batch.schema.field(at_text).type)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*own, batch.column(len(names)), pa.array(np.diff(starts)), pa.array(collapsed, pa.string()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary())],
                [*names, key, "n_words", "collapsed", octave, offset, packed],
            )
            for k in range(0, len(found), 256):
                part = found[k : k + 256]
                keys = batch.column(len(names)).take(pa.array([f[0] for f in part], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.nulls(len(part), batch.schema.field(c).type) for c in range(len(names))],
                        keys,
                        pa.nulls(len(part), pa.int64()),
                        pa.nulls(len(part), pa.string()),
                        pa.array([f[1] for f in part], pa.int32()),
                        pa.array([f[2] for f in part], pa.int64()),
                        pa.array([_packed(f[3]) for f in part], pa.binary()),
                    ],
                    [*names, key, "n_words", "collapsed", octave, offset, packed],
                )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            each = [_unpacked(b.as_py()) for b in batch.column(3)]
            at = batch.column(1).to_numpy(zero_copy_only=False)
            for scale in np.unique(at).tolist():
                rows = np.flatnonzero(at == scale)
                starts = np.concatenate(([0], np.cumsum([len(e) for e in each])))
                flat, begins = _joined(np.concatenate(each), starts, rows)
                tile = np.repeat(np.arange(len(rows)), np.diff(begins))
                flat = np.where(flat < 0, flat, flat + (tile << 32))  # tiles number their words on their own
                for s, e, q in solved(_spread(flat), scale, least):
                    t = int(tile[s])
                    r = int(rows[t])
                    base = batch.column(2)[r].as_py() - int(begins[t])
                    out.append((batch.column(0)[r].as_py(), q, s + base, e + base))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [key, "period", "start", "stop"])

    exploded = stored(in_arrow(keyed, explode, f"{kinds}, `{key}` long, n_words long, collapsed string, `{octave}` int, `{offset}` long, `{packed}` binary"), "tiles")
    dealt = exploded.filter(F.col(octave).isNotNull()).select(key, octave, offset, packed).repartition(key, octave, offset)
    parts = in_arrow(dealt, solve, f"`{key}` long, period long, start long, stop long")
    # stitched: a fragment that shares less than a period with all before it begins a run
    order = Window.partitionBy(key, "period").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = parts.withColumn("_new", (reach.isNull() | (F.col("start") > reach - F.col("period"))).cast("int"))
    begun = begun.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = begun.groupBy(key, "period", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    stitched = stitched.select(key, F.struct("start", (F.col("stop") - F.col("start")).alias("length"), "period").alias("run"))
    by_start = "array_sort(collect_list(run), (a, b) -> CASE WHEN a.start <> b.start THEN CASE WHEN a.start < b.start THEN -1 ELSE 1 END WHEN a.period < b.period THEN -1 WHEN a.period > b.period THEN 1 ELSE 0 END)"
    runs = stitched.groupBy(key).agg(F.expr(by_start).alias("runs"))

    whole = exploded.filter(F.col(octave).isNull()).drop(octave, offset, packed)
    plain = whole.filter("collapsed IS NOT NULL").withColumn("runs", F.expr(f"CAST(array() AS array<{RUN}>)"))
    held = whole.filter("collapsed IS NULL").drop("collapsed").join(runs, key, "left")
    held = held.withColumn("runs", F.coalesce("runs", F.expr(f"CAST(array() AS array<{RUN}>)")))
    width = len(names) + 3  # with the key, the number of words and the runs
    order_of = [*names, key, "n_words", "runs"]

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3 << 20):
            codes, starts, distinct = words_of(text_of(batch))
            words = distinct.to_pylist()
            lists = batch.column(width - 1)
            flat = lists.flatten()
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            begin, length, period = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("start", "length", "period"))
            out = []
            for k, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                change = np.zeros(b - a + 1, np.int64)
                r = slice(ends[k], ends[k + 1])
                np.add.at(change, begin[r] + period[r], 1)
                np.add.at(change, begin[r] + length[r], -1)
                text = " ".join([words[c] for c in codes[a:b][np.cumsum(change)[:-1] == 0]])
                out.append(_sha256(text) if digest else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*order_of, "collapsed"])

    finished = in_arrow(held.select(*order_of), collapse, f"{kinds}, `{key}` long, n_words long, runs array<{RUN}>, collapsed string")
    rows = finished.unionByName(plain).drop(key)
    return rows.drop("text") if digest else rows


def repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): by a checksum of the id, the words after a place of a tenth of the texts repeat with a period.

    Rows with a null id stay as they are; texts that change have one space between words.
    """

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3 << 20):
            sums = [0 if i is None else zlib.crc32(str(i).encode()) for i in batch.column(0).to_pylist()]
            chosen = np.array([i.is_valid and h % 10 == 0 for i, h in zip(batch.column(0), sums)], bool)
            texts = text_of(batch)
            out = texts.to_pylist()
            rows = np.flatnonzero(chosen)
            codes, starts, distinct = words_of(texts.take(pa.array(rows)))
            words = distinct.to_pylist()
            for k, r in enumerate(rows.tolist()):
                own, g = codes[starts[k] : starts[k + 1]], sums[r] // 10
                if n := len(own):
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    i = np.arange(n)
                    out[r] = " ".join([words[c] for c in own[np.where(i < a, i, a + (i - a) % p)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), edit, "doc_id long, text string")


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_runs(repeated_tails(table(spark, sf_dir, "documents")), digest=True)
    best = F.expr("reduce(runs, runs[0], (b, r) -> CASE WHEN r.length > b.length THEN r ELSE b END)")  # runs come by start, then period
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = rows.withColumn("_best", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )


QUERIES = {"op13_word_runs": op13_word_runs}
SQL: dict[str, str] = {}
