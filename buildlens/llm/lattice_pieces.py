"""SentencePiece encoding and decoding as a relational lattice.

Tasks cut their texts into words (where no piece can cross: before the space mark, and between characters that stand
next to each other in no piece), in blocks of some ``BLOCK_BYTES``, and send each distinct word of a block once.
The distinct words are exploded into their substrings of at most the longest piece's length, which meet the piece table
in an equi-join. The edges of each word are grouped, and a fold with Spark's ``aggregate`` picks the path; unknown
characters become their bytes. Ids go back to the blocks that asked for them, packed, and meet the blocks' word numbers.

Models differ in what the best path is. For unigram models it is the path of the greatest sum of scores, a Viterbi fold
over positions. Scores of BPE models are only ranks of merges, and the sum of ranks picks other pieces than the library;
the fold for them joins neighbours over the lattice's edges in the order of the ranks, the leftmost of equal ones first,
which gives the library's ids. One pass over the edges does, but where a piece is made of a part of a later rank
(``merge_order``).

Words of more than ``LONG`` characters have more bounds than a number has bits, and are merged with a heap in Arrow
batches: the same rule. Words of ``SECTION`` input partitions are folded together, so that a word has a bounded number
of blocks to go to. The texts are read twice and must come in the same partitions and order then, as files do; blocks
that differ raise. Null and empty texts have no ids, and an empty table gives no rows. Rows with null or repeated ids
each give a row; equal texts have equal ids. Very long texts are a block of their own. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import gathered, in_arrow, slices, table, text_of

MARK = "▁"
#: Longest word that is folded by bits.
LONG = 48
#: UTF-8 bytes of the texts of a block, and input partitions whose words are folded together.
BLOCK_BYTES, SECTION = 24 << 20, 256
#: UTF-8 bytes of the texts that are cut at once.
BATCH = 2 << 20


def piece_table(spark: SparkSession, model_file: str) -> tuple[DataFrame, list[int]]:
    """(piece, id, score) of the pieces that text can match, and the ids of the 256 bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    every = range(sp.get_piece_size())
    plain = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in every if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    by_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
    return spark.createDataFrame(plain, "piece string, id int, score double"), [by_byte.get(b, sp.unk_id()) for b in range(256)]


def numbered(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all entries, where each list's codes start (with the end of the last), and the distinct entries."""
    coded = lists.flatten().dictionary_encode()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return coded.indices.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), coded.dictionary


def pairs_in(pieces: Iterable[str]) -> np.ndarray:
    """Characters that stand next to each other in some piece, as sorted numbers."""
    return np.unique(np.array([ord(x) << 21 | ord(y) for p in pieces for x, y in zip(p, p[1:])], np.int64))


def joined(words: pa.Array) -> pa.StringScalar:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\0")[0]


def cut_at_pairs(words: pa.Array, pairs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Parts of words without the character 0, cut between characters that no piece holds next to each other, and where
    each word's parts start (with the end of the last)."""
    if not len(words):
        return words, np.zeros(1, np.int64)
    signs = np.frombuffer(joined(words).as_py().encode("utf-32-le"), np.uint32).astype(np.int64)
    both = signs[:-1] << 21 | signs[1:]
    known = pairs[np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)] == both if len(pairs) else np.zeros(len(both), bool)
    cuts = np.flatnonzero(~known & (signs[:-1] != 0) & (signs[1:] != 0)) + 1
    word = np.cumsum(signs == 0)[cuts]
    whole = np.insert(signs, cuts, 0).astype(np.uint32).tobytes().decode("utf-32-le")
    return pc.split_pattern(pa.array([whole]), "\0").flatten(), np.concatenate(([0], np.cumsum(1 + np.bincount(word, minlength=len(words)))))


def words_in(texts: pa.Array, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``numbered`` words of texts; an empty text has none."""
    held = pc.match_substring(texts, "\0")  # texts that hold the cut mark are cut one by one
    none = pc.or_(held, pc.equal(texts, ""))
    plain = pc.if_else(none, "", texts)
    cut = pc.binary_join_element_wise(MARK, pc.replace_substring(plain, " ", f"\0{MARK}"), "")
    runs = pc.match_substring_regex(plain, f"  |^ |{MARK}")
    if pc.any(runs).as_py():
        whole = pc.binary_join_element_wise(MARK, pc.replace_substring(plain, " ", MARK), "")
        cut = pc.if_else(runs, pc.replace_substring_regex(whole, f"([^{MARK}]){MARK}", f"\\1\0{MARK}"), cut)
    codes, starts, words = numbered(pc.split_pattern(cut, "\0"))
    none = none.to_numpy(zero_copy_only=False)
    codes = np.delete(codes, starts[:-1][none])  # the space mark that stands before nothing
    starts = starts - np.concatenate(([0], np.cumsum(none)))
    parts, part_starts = cut_at_pairs(words, pairs)
    coded = parts.dictionary_encode()
    codes, at = gathered(coded.indices.to_numpy(zero_copy_only=False), part_starts, codes)
    starts, words = at[starts], coded.dictionary
    if pc.any(held).as_py():
        code_of = {w: k for k, w in enumerate(words.to_pylist())}
        each = [codes[a:b] for a, b in zip(starts[:-1], starts[1:])]
        for r in np.flatnonzero(held.to_numpy(zero_copy_only=False)):
            text = MARK + texts[int(r)].as_py().replace(" ", MARK)
            signs = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            apart = ~np.isin(signs[:-1] << 21 | signs[1:], pairs) | ((signs[1:] == ord(MARK)) & (signs[:-1] != ord(MARK)))
            cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(text)]
            each[r] = np.array([code_of.setdefault(text[a:b], len(code_of)) for a, b in zip(cuts, cuts[1:])], np.int64)
        codes, words = np.concatenate(each), pa.array(list(code_of), pa.string())
        starts = np.concatenate(([0], np.cumsum([len(e) for e in each], dtype=np.int64)))
    return codes, starts, words


def blocks_of(batches: Iterator[pa.RecordBatch], pairs: np.ndarray) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """Blocks of the task's texts: (block, ids of documents, their numbers of words, codes of the words, words)."""
    import xxhash

    task = TaskContext.get().partitionId()
    ids: list[pa.Array] = []
    sizes: list[np.ndarray] = []
    codes: list[np.ndarray] = []
    kept = pa.array([], pa.string())
    filled, number = 0, 0

    def block():
        key = xxhash.xxh3_64_intdigest(f"{task} {number} {joined(kept)}") - (1 << 63)
        return key, pa.concat_arrays(ids), np.concatenate(sizes).astype(np.int32), np.concatenate(codes), kept

    for batch in slices(batches, most=BATCH):
        texts = text_of(batch)
        own, starts, words = words_in(texts.cast(pa.string()), pairs)
        at = pc.index_in(words, value_set=kept)
        fresh = pc.is_null(at)
        there = fresh.to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int32)
        at[there] = len(kept) + np.arange(there.sum())
        kept = pa.concat_arrays([kept, words.filter(fresh)])
        # a copy, as a slice would keep the batch's texts too
        ids.append(pa.concat_arrays([batch.column(0), batch.column(0).slice(0, 0)]))
        sizes.append(np.diff(starts).astype(np.int32))
        codes.append(at[own])
        filled += pc.sum(pc.binary_length(texts)).as_py() or 0
        if filled >= BLOCK_BYTES:
            yield block()
            ids, sizes, codes, kept, filled, number = [], [], [], kept.slice(0, 0), 0, number + 1
            pa.default_memory_pool().release_unused()
    if ids:
        yield block()
    # the process waits for other tasks with what it holds
    pa.default_memory_pool().release_unused()


def packed_ints(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, np.int32), codec="zstd", asbytes=True) if len(values) else b""


def unpacked_ints(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.int32) if n else np.zeros(0, np.int32)


def block_words(docs: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(section, word, refs): the distinct words, and the (block, at) that hold them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        section = TaskContext.get().partitionId() // SECTION
        for block, _, _, _, words in blocks_of(batches, pairs):
            for a in range(0, len(words), 50_000):
                part = words.slice(a, 50_000)
                columns = [np.full(len(part), section, np.int32), part, np.full(len(part), block), np.arange(a, a + len(part), dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["section", "word", "block", "at"])

    # a word becomes many edges, so small shuffles aren't joined to larger ones: the number of partitions is given
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = in_arrow(docs, emit, "section int, word string, block long, at int").repartition(parts, "section", "word")
    # groups are sorted by their first key: numbers are compared faster than words
    whole = each.groupBy(F.xxhash64("word").alias("hash"), "section", "word").agg(F.collect_list(F.struct("block", "at")).alias("refs"))
    return whole.select("section", "word", "refs")


def block_codes(docs: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(block, doc_ids, sizes, n, words, codes): the texts as numbers of their block's words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, sizes, codes, words in blocks_of(batches, pairs):
            row = [[block], [ids.to_pylist()], [sizes], [len(codes)], [len(words)], [packed_ints(codes)]]
            types = [pa.int64(), pa.list_(ids.type), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["block", "doc_ids", "sizes", "n", "words", "codes"])

    return in_arrow(docs, emit, f"block long, doc_ids array<{kind}>, sizes array<int>, n long, words long, codes binary")


def packed_by_block(words: DataFrame, by_heap) -> DataFrame:
    """(block, m, n, at, counts, ids): ids of words for each block that holds them, from (word, refs, ids)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            if lists.null_count:
                own = batch.column(0).to_pylist()
                lists = pa.array([by_heap(own[k]) if v is None else v for k, v in enumerate(lists.to_pylist())], pa.list_(pa.int32()))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)))
            refs = batch.column(1).flatten()
            blocks, places = (refs.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            rows = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((places, blocks))
            blocks, places, rows = blocks[order], places[order], rows[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                ids, starts = gathered(flat, ends, rows[a:b])
                out.append((int(blocks[a]), int(b - a), len(ids), packed_ints(places[a:b]), packed_ints(np.diff(starts)), packed_ints(ids)))
            types = [pa.int64()] * 3 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["block", "m", "n", "at", "counts", "ids"])

    return in_arrow(words.select("word", "refs", "ids"), emit, "block long, m long, n long, at binary, counts binary, ids binary")


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def shifted(name: str, by: int) -> Column:
    return F.shiftleft(F.col(name).cast("long"), by)


def bits_of(number: Column, at: int, n: int) -> Column:
    return F.shiftright(number, at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")


def merge_order(scores: dict[str, float]) -> dict[str, bool]:
    """The pieces that merges can reach, and which of them are late: what happens inside a piece until it is whole does
    not depend on what stands around it, so its own merges tell. A piece is late if one of them has a later rank than
    the next; a single pass in the order of ranks would come to the next too early."""
    late = {}
    for piece in scores:
        parts, ranks = list(piece), []
        while len(parts) > 1:
            fits = [(-scores[x + y], a) for a, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in scores]
            if not fits:
                break
            rank, a = min(fits)
            ranks.append(rank)
            parts[a : a + 2] = [parts[a] + parts[a + 1]]
        if len(parts) == 1:
            late[piece] = ranks != sorted(ranks)
    return late


def joins_of(edges: Column) -> Column:
    """Edges of two and more characters as bits: both ends, and the places between; cheapest first as ``edges`` are."""
    return F.transform(
        F.filter(edges, lambda e: e["k"] > e["i"] + 1),
        lambda e: F.struct(bit(e["i"]).bitwiseOR(bit(e["k"])).alias("ends"), (bit(e["k"]) - bit(e["i"] + 1)).alias("inner")),
    )


def merged(joins: Column, n: Column) -> Column:
    """Bits of the bounds of the pieces after all merges."""

    def step(bounds: Column, _: Column) -> Column:
        # an edge joins two neighbours if both its ends are bounds and one bound lies inside it
        fits = F.filter(joins, lambda e: (bounds.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(bounds.bitwiseAND(e["inner"])) == 1))
        return F.coalesce(bounds.bitwiseAND(F.bitwise_not(F.get(fits, F.lit(0))["inner"])), bounds)

    # each merge takes an edge of its own, and there are fewer merges than characters
    steps = F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), F.least(n - 1, F.size(joins)))
    return F.aggregate(steps, bit(n + 1) - 1, step)


def merged_in_order(joins: Column, n: Column) -> Column:
    """As ``merged``, by one pass over the edges; for words without late pieces."""

    def step(bounds: Column, e: Column) -> Column:
        fits = (bounds.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(bounds.bitwiseAND(e["inner"])) == 1)
        return F.when(fits, bounds.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(bounds)

    return F.aggregate(joins, bit(n + 1) - 1, step)


def best_path(edges: Column, n: Column) -> Column:
    """Bounds of the path with the least sum of costs; a character without a piece costs more than any pieces do."""
    unknown = F.lit(1e6)

    def step(best: Column, k: Column) -> Column:
        into = F.transform(F.filter(edges, lambda e: e["k"] == k), lambda e: F.struct((F.get(best, e["i"])["cost"] + e["cost"]).alias("cost"), e["i"].alias("start")))
        alone = F.struct((F.get(best, k - 1)["cost"] + unknown).alias("cost"), (k - 1).alias("start"))
        return F.concat(best, F.array(F.array_min(F.concat(into, F.array(alone)))))

    first = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(-1).alias("start")))
    best = F.aggregate(F.sequence(F.lit(1), n), first, step)
    return F.aggregate(
        F.sequence(F.lit(1), n), F.array(n), lambda path, _: F.when(path[0] <= 0, path).otherwise(F.concat(F.array(F.get(best, path[0])["start"]), path))
    )


def _pieces(edges: Column, bits: Column) -> Column:
    """(i, id) of the edges between neighbouring bounds."""
    span = F.filter(edges, lambda e: bits.bitwiseAND(bit(e["k"] + 1) - bit(e["i"])) == bit(e["i"]).bitwiseOR(bit(e["k"])))
    return F.transform(span, lambda e: F.struct(e["i"].alias("i"), e["id"].alias("id")))


def _ids(word: Column, edges: Column, bounds: Column, byte_ids: list[int]) -> Column:
    of_byte = F.array(*map(F.lit, byte_ids))

    def between(x: Column, at: Column) -> Column:
        end = F.get(bounds, at + 1)
        held = F.filter(edges, lambda e: (e["i"] == x) & (e["k"] == end))
        code = F.hex(F.encode(F.substring(word, x + 1, end - x), "UTF-8"))
        spelled = F.transform(F.sequence(F.lit(1), F.greatest(F.length(code) / 2, F.lit(1)).cast("int")), lambda b: F.get(of_byte, F.conv(F.substring(code, 2 * b - 1, F.lit(2)), 16, 10).cast("int")))
        return F.when(F.size(held) > 0, F.transform(held, lambda e: e["id"])).otherwise(spelled)

    return F.flatten(F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), between))


def _by_heap(pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
    def ids_of(word: str) -> list[int]:
        symbols: list[str] = list(word)
        before, after = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            if 0 <= a < len(symbols) and after[a] < len(symbols):
                both = symbols[a] + symbols[after[a]]
                if both in pieces:
                    heapq.heappush(heap, (-pieces[both][1], a, both))

        for a in range(len(symbols)):
            offer(a)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = after[a]
            if not symbols[a] or b >= len(symbols) or symbols[a] + symbols[b] != both:
                continue
            symbols[a], symbols[b] = both, ""
            after[a] = after[b]
            if after[a] < len(symbols):
                before[after[a]] = a
            offer(a)
            offer(before[a])
        out: list[int] = []
        for s in filter(None, symbols):
            out += [pieces[s][0]] if s in pieces else [byte_ids[x] for x in s.encode()]
        return out

    return ids_of


def word_ids(words: DataFrame, pieces: DataFrame, byte_ids: list[int], fold: str = "merges") -> DataFrame:
    """``words`` (word, which is distinct within the other plain columns, and refs) with the ids of the words; null for
    words that are too long for the fold of merges."""
    spark = words.sparkSession
    scores = {r["piece"]: (r["id"], r["score"]) for r in pieces.collect()}
    late = merge_order({p: score for p, (_, score) in scores.items()}) if fold == "merges" else dict.fromkeys(scores, False)
    rank_of = {score: rank for rank, score in enumerate(sorted({score for _, score in scores.values()}, reverse=True))}
    rows = [(p, i, score, rank_of[score], late[p]) for p, (i, score) in scores.items() if p in late]
    known = spark.createDataFrame(rows, "piece string, id int, score double, rank int, late boolean")
    span = max(map(len, scores), default=1)
    keys = [c for c in words.columns if c != "refs"]
    n = F.length("word")
    folds = n <= LONG if fold == "merges" else F.lit(True)
    # the number is made and used in one branch; rows come in its order, so that grouping them by it first sorts nothing anew
    words = words.withColumn("number", F.monotonically_increasing_id())
    keys = ["number", *keys]
    starts = words.select(*keys, "refs", F.explode(F.sequence(F.lit(0), F.when(folds, n - 1).otherwise(0))).alias("i"))
    # the word's blocks travel with its first character alone
    starts = starts.select(*keys, "i", F.when(F.col("i") == 0, F.col("refs")).alias("refs"))
    ends = F.sequence(F.col("i") + 1, F.when(folds, F.least(n, F.col("i") + span)).otherwise(1))
    spans = starts.select(*keys, "i", "refs", F.explode(ends).alias("k"))
    one = F.col("k") == F.col("i") + 1
    spans = spans.select(*keys, "i", "k", F.when(one, F.col("refs")).alias("refs"), F.substring("word", F.col("i") + 1, F.col("k") - F.col("i")).alias("piece"))
    # the piece table is a vocabulary: its size is fixed and does not follow the corpus
    met = spans.join(F.broadcast(known), "piece", "left").filter(F.col("id").isNotNull() | one)
    there = F.col("id").isNotNull()
    if fold == "merges":  # bounds of at most LONG take 6 bits, so an edge is a number: order of its rank, bounds, id
        edge = F.when(there, shifted("rank", 40).bitwiseOR(shifted("i", 34)).bitwiseOR(shifted("k", 28)).bitwiseOR(F.col("id").cast("long")))
    else:
        edge = F.when(there, F.struct((-F.col("score")).alias("cost"), "i", "k", "id"))
    lattice = met.groupBy(*keys).agg(
        F.sort_array(F.collect_list(edge)).alias("edges"), F.first("refs", ignorenulls=True).alias("refs"), F.max(F.coalesce("late", F.lit(False))).alias("late")
    )
    if fold != "merges":
        bounds = lattice.withColumn("bounds", best_path(F.col("edges"), n))
        return bounds.select(*keys[1:], "refs", _ids(F.col("word"), F.col("edges"), F.col("bounds"), byte_ids).alias("ids"))
    spelled = F.transform("edges", lambda e: F.struct(bits_of(e, 34, 6).alias("i"), bits_of(e, 28, 6).alias("k"), bits_of(e, 0, 28).alias("id")))
    joins = lattice.withColumn("edges", spelled).withColumn("joins", joins_of(F.col("edges")))
    picked = F.when(n > LONG, F.lit(None)).when(F.col("late"), merged(F.col("joins"), n)).otherwise(merged_in_order(F.col("joins"), n))
    whole = joins.withColumn("bits", picked).withColumn("held", F.array_sort(_pieces(F.col("edges"), F.col("bits"))))
    bounds = F.filter(F.sequence(F.lit(0), n), lambda x: F.col("bits").bitwiseAND(bit(x)) != 0)
    # fewer edges than pieces: some characters have no piece and are spelled
    all_held = F.size("held") == F.bit_count("bits") - 1
    ids = F.when(n > LONG, F.lit(None)).when(all_held, F.transform("held", lambda e: e["id"])).otherwise(_ids(F.col("word"), F.col("edges"), bounds, byte_ids))
    return whole.select(*keys[1:], "refs", ids.alias("ids"))


def encoded(docs: DataFrame, pieces: DataFrame, byte_ids: list[int], fold: str = "merges") -> DataFrame:
    """(doc_id, ids) of every row."""
    vocabulary = {r["piece"]: (r["id"], r["score"]) for r in pieces.collect()}
    pairs = pairs_in(vocabulary)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = packed_by_block(word_ids(block_words(docs, pairs), pieces, byte_ids, fold), _by_heap(vocabulary, byte_ids))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def filled(texts: pa.Table, words: pa.Table) -> pa.Table:
        rows = words.to_pylist()
        at, counts, ids = ([unpacked_ints(r[c], r["n" if c == "ids" else "m"]) for r in rows] for c in ("at", "counts", "ids"))
        none = [np.zeros(0, np.int32)]
        at, counts, ids = np.concatenate(at + none), np.concatenate(counts + none), np.concatenate(ids + none)
        order = np.argsort(at, kind="stable")
        flat, ends = gathered(ids, np.concatenate(([0], np.cumsum(counts, dtype=np.int64))), order)
        out = []
        for r in texts.to_pylist():
            if not np.array_equal(at[order], np.arange(r["words"])):
                raise ValueError("the texts came in other partitions or another order when they were read again; write them first")
            own, starts = gathered(flat, ends, unpacked_ints(r["codes"], r["n"]))
            cuts = starts[np.concatenate(([0], np.cumsum(r["sizes"], dtype=np.int64)))]
            offsets = pa.array(cuts.astype(np.int32))
            out.append(pa.table({"doc_id": pa.array(r["doc_ids"], texts.schema.field("doc_ids").type.value_type), "ids": pa.ListArray.from_arrays(offsets, pa.array(own, pa.int32()))}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], texts.schema.field("doc_ids").type.value_type), "ids": pa.array([], pa.list_(pa.int32()))})

    return block_codes(docs, pairs).groupBy("block").cogroup(known.groupBy("block")).applyInArrow(filled, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, pieces: DataFrame, byte_ids: list[int]) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): pieces and bytes as hexadecimal, joined, read as UTF-8, less the first space."""
    spark = rows.sparkSession
    codes = pieces.select("id", F.hex(F.encode(F.replace("piece", F.lit(MARK), F.lit(" ")), "UTF-8")).alias("code"))
    codes = codes.union(spark.createDataFrame([(i, f"{b:02X}") for b, i in enumerate(byte_ids)], "id int, code string"))
    each = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.posexplode_outer("ids").alias("at", "id"))
    held = F.when(F.col("at").isNotNull(), F.struct("at", "code"))
    whole = each.join(F.broadcast(codes), "id", "left").groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(held)).alias("codes"))
    spelled = F.decode(F.unhex(F.array_join(F.transform("codes", lambda c: c["code"]), "")), "UTF-8")
    return whole.select("doc_id", F.substring(spelled, 2, 1 << 30).alias("text"))


def op2_lattice_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces, byte_ids = piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    rows = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces, byte_ids)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


QUERIES = {"op2_lattice_pieces": op2_lattice_pieces}
SQL: dict[str, str] = {}
