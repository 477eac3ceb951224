"""The training-data operators on small fixtures: odd rows, brute force, round trips."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from buildlens.llm import curve_pack, evidence_language, imatch, interleave, lattice_pieces, line_crf, ngram_join, superkmer, token_orc, topk
from buildlens.llm.catalog import registered
from buildlens.llm.common import Encoder
from buildlens.llm.components import components

QUERIES, SQL = registered()
BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("the of and reading water stone over under mountain river quick slow light dark seven".split()) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, a clashing extra column."""
    long = prose(1, 30_000)
    copy = prose(2, 120)
    near = copy.replace("the", "thy", 1)
    rows = [
        (1, copy, "en", "a", 5), (2, copy, "en", "a", 5), (3, near, "en", None, None), (3, near, "en", None, None), (4, None, None, "b", None),
        (5, "", "en", "b", 0), (6, long, "en", "c", 1), (7, " \n\t ", "en", "c", 1), (None, "no id here.", "en", "c", 1), (8, "Ein anderer Text über Öl.", "de", "c", 1),
        (9, "x\x00y   z  世界 é", "en", "c", 1), (10, "be " * 200, "en", "c", 1), (11, prose(3, 60) + " " + copy, "en", "c", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("words", F.lit("clash")).withColumn("shard", F.lit("clash"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == []


def test_encoder_gives_the_library_ids():
    rng = random.Random(7)
    texts = ["", " ", "  ", "a  b", "don't  won't ", "İSTANBUL ΣΑΣ á ́b", "<|endoftext|> a", "a\x00b c"]
    texts += ["".join(rng.choice(" \n\tab'sé́.1 　") for _ in range(30)) for _ in range(500)]
    for path in (BYTE, WORD):
        encoder = Encoder(path)
        ids, starts = encoder.encode(pa.array(texts))
        for k, want in enumerate(encoder.plain(texts)):
            assert ids[starts[k] : starts[k + 1]].tolist() == want.tolist(), texts[k]


def test_token_files(spark, odd, none, tmp_path):
    token_orc.write_token_files(odd, str(tmp_path / "t"), BYTE)
    got = token_orc.with_crc32(token_orc.read_token_files(spark, str(tmp_path / "t"))).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    encoder, at = Encoder(BYTE), 0
    assert len(got) == len(rows)
    for r, (there, doc_id, text) in zip(got, rows):
        ids = np.append(encoder.plain([text])[0], 0).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id if there else None, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_orc.lookup(spark, str(tmp_path / "t"), [6]).count() == 1
    token_orc.write_token_files(none, str(tmp_path / "e"), BYTE)
    assert token_orc.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_pieces_round_trip(spark, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    pieces, byte_ids = lattice_pieces.piece_table(spark, PIECE)
    docs = odd.unionByName(spark.createDataFrame([(50, "q" * 120 + " <s> ▁x a▁▁b", "en", "a", 1)], SCHEMA), allowMissingColumns=True)
    got = lattice_pieces.encoded(docs, pieces, byte_ids)
    assert sorted(map(tuple, [r.ids for r in got.collect()])) == sorted(tuple(sp.encode(r.text or "")) for r in docs.collect())
    texts = lattice_pieces.decoded(got, pieces, byte_ids).collect()
    assert sorted(r.text for r in texts) == sorted((r.text or "").replace("▁", " ") for r in docs.collect())
    assert lattice_pieces.encoded(none, pieces, byte_ids).count() == 0


def test_words_of_sliced_texts_are_cut_where_no_piece_crosses():
    import pyarrow as pa

    texts = ["é" * 40 + " b1a  c", "", " Çé x▁y", "a\0b c", "12,ab", "日本 語"] * 3
    for pieces in ([], ["▁a", "abc", "éé", "▁▁", "12"]):
        held = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}

        def parts(text):
            out = []
            for sign in "▁" + text.replace(" ", "▁") if text else "":
                if out and out[-1][-1] + sign in held and not (sign == "▁" != out[-1][-1]):
                    out[-1] += sign
                else:
                    out.append(sign)
            return out

        for a in range(len(texts)):
            codes, starts, words = lattice_pieces.words_in(pa.array(texts).slice(a, 2), lattice_pieces.pairs_in(pieces))
            assert [[words[int(c)].as_py() for c in codes[x:y]] for x, y in zip(starts[:-1], starts[1:])] == [parts(t) for t in texts[a : a + 2]]


def test_one_pass_over_the_edges_is_only_for_pieces_that_are_not_late(spark):
    # abcd outranks abc, but needs it: ab, abc, abcd is the only way to it
    ranks = {"bc": -1.0, "abcd": -2.0, "abc": -3.0, "de": -4.0, "xy": -9.0, "wxyz": -5.0}
    assert lattice_pieces.merge_order(ranks) == {"bc": False, "abcd": True, "abc": False, "de": False, "xy": False}
    scores = {c: -20.0 for c in "abcdexy"} | ranks
    pieces = spark.createDataFrame([(p, k, s) for k, (p, s) in enumerate(scores.items())], "piece string, id int, score double")
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abcde", repeat=n)]
    got = lattice_pieces.word_ids(spark.createDataFrame([(w, []) for w in words], "word string, refs array<int>"), pieces, [0] * 256)
    by_heap = lattice_pieces._by_heap({p: (k, s) for k, (p, s) in enumerate(scores.items())}, [0] * 256)
    assert {r.word: r.ids for r in got.collect()} == {w: by_heap(w) for w in words}


def test_viterbi_fold_is_the_best_path(spark):
    scores = {"a": -1.0, "b": -1.2, "ab": -1.5, "ba": -1.1, "aba": -3.0, "bb": -0.7}
    pieces = spark.createDataFrame([(p, k, s) for k, (p, s) in enumerate(scores.items())], "piece string, id int, score double")
    words = ["".join(w) for n in (1, 2, 5) for w in itertools.product("ab", repeat=n)]
    got = {r.word: r.ids for r in lattice_pieces.word_ids(spark.createDataFrame([(w, []) for w in words], "word string, refs array<int>"), pieces, [0] * 256, "viterbi").collect()}

    def paths(w):
        return [[]] if not w else [[p, *rest] for p in scores if w.startswith(p) for rest in paths(w[len(p) :])]

    names = list(scores)
    for w in words:
        assert sum(scores[names[i]] for i in got[w]) == pytest.approx(max(sum(scores[p] for p in path) for path in paths(w)))


def test_language(spark, sf_dir, odd, none):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op3_evidence_language"](spark, sf_dir).collect()
    assert len(got) == len(truth) and sum(r.language == truth[r.doc_id] for r in got) > 0.98 * len(got)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)
    assert evidence_language.accepted(odd).columns == odd.columns
    assert evidence_language.accepted(none).count() == 0
    pages = QUERIES["page_language"](spark, sf_dir)
    assert pages.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_rare_language_keeps_its_class_and_copies_weigh_once(spark):
    common = [(f"{prose(k, 12)} n{k}", "en") for k in range(3_000)] + [("one very common text of many copies", "en")] * 2_000
    rare = [(f"tämä on harvinainen kieli ja sen sanat {k}", "fi") for k in range(3)]
    rows = spark.createDataFrame(common + rare, "text string, lang string").repartition(8)
    taken = evidence_language.sampled(rows, sample_rows=20).collect()
    assert sorted(r.text for r in taken if r.lang == "fi") == sorted(t for t, _ in rare)
    assert len(taken) == len(set(taken)) and abs(len(taken) - 3 - evidence_language.LANGUAGE_ROWS) < 150
    model = evidence_language.fit_text_model(rows, sample_rows=20)
    assert model["names"] == ["en", "fi"]
    docs = spark.createDataFrame([(k, t, None, None, "h") for k, (t, _) in enumerate(rare)], "id long, text string, markup string, suffix string, host string")
    assert {r.language for r in evidence_language.identified(docs, model).collect()} == {"fi"}


def test_more_than_64_languages(spark):
    rng, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(70):
        words = ["".join(rng.choices(letters, k=7)) for _ in range(12)]
        rows += [(10 * k + i, " ".join(rng.choices(words, k=30 if k else 60)), f"x{k:02}", "s", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = evidence_language.fit_text_model(docs)
    assert model["names"] == sorted({r[2] for r in rows})
    truth = {r[0]: r[2] for r in rows}
    got = evidence_language.identified(evidence_language.document_evidence(docs), model).collect()
    assert len(got) == len(rows) and all(r.language == truth[r.id] and not r.rejected for r in got)


def test_evidence_decides_where_the_text_is_silent(spark, sf_dir):
    model = evidence_language.fit_text_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = {r.lang: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars > 500").collect()}
    rows = [(k, texts["de"], "de", "de", "h.de") for k in range(30)] + [(100 + k, texts["en"], "en", "com", "h.com") for k in range(30)]
    rows += [(500, "", None, None, "h.de"), (501, None, "de", "", None), (502, "...", None, "com", "")]
    got = {r.id: r.language for r in evidence_language.identified(spark.createDataFrame(rows, "id long, text string, markup string, suffix string, host string"), model).collect()}
    assert (got[500], got[501], got[502]) == ("de", "de", "en")


def test_jaccard_against_brute_force(spark, odd, none):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(12)]
    rows = []
    for k in range(150):  # one group of near copies of many grades, and others
        w = list(base[0] if k < 100 else base[k % 12])
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w), "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd.drop("words", "shard").withColumn("doc_id", F.col("doc_id") + 1000))
    small, ngram_join.CHUNK_ROWS = ngram_join.CHUNK_ROWS, 16  # several chunks
    try:
        got = ngram_join.classes(docs).collect()
        kept = ngram_join.deduplicated(docs).collect()
    finally:
        ngram_join.CHUNK_ROWS = small
    sets, ids = {}, {}
    for r in docs.collect():
        w = (r.text or "").lower().encode().split()
        sets[r.text or ""] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        ids.setdefault(r.text or "", []).append(r.doc_id)
    near = {t: {u for u in sets if u != t and sets[t] and len(sets[t] & sets[u]) * 5 >= 4 * len(sets[t] | sets[u])} for t in sets}
    links = {d: len(near[t]) for t in sets for d in ids[t]}
    assert len(got) == docs.count() and all(r.links == links[r.doc_id] for r in got if r.doc_id is not None)
    roots = {}
    for t in sets:
        seen, todo = {t}, [t]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        roots[t] = min((d for u in seen for d in ids[u] if d is not None), default=None)
    assert {(r.doc_id, r.class_id) for r in got} == {(d, roots[t]) for t in sets for d in ids[t]}
    assert len(kept) == len({r.class_id for r in got})
    assert ngram_join.classes(none).count() == 0 and ngram_join.deduplicated(none).count() == 0


def test_bayesian_bounds():
    need = ngram_join.needed()
    assert need[0] == 0 and all(a <= b <= a + 1 for a, b in zip(need, need[1:]))
    assert 0.6 * ngram_join.HASHES < need[-1] < ngram_join.THRESHOLD * ngram_join.HASHES


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def law_of_rows(rows, shards):
    counts = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_shards(spark, sf_dir, odd, none):
    rows = QUERIES["op5_stratified_shards"](spark, sf_dir).collect()
    law_of_rows(rows, 16)
    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.size == len(texts[r.doc_id].text.encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].text.encode()) for r in rows)
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = interleave.interleaved(many, bin_rows=50).collect()
    law_of_rows(got, 16)
    for source in {r.source for r in got}:  # every shard matches the mixture
        n = [sum(r.source == source and r.shard == s for r in got) for s in range(16)]
        assert max(n) - min(n) <= 2
    assert len(interleave.interleaved(odd).collect()) == odd.count()
    assert interleave.interleaved(none).count() == 0


def test_packing(spark, odd, none):
    pieces = curve_pack.packed(odd, WORD).collect()
    encoder = Encoder(WORD)
    want = sorted(np.append(encoder.plain([r.text or ""])[0], 1).astype("<u4").tobytes() for r in odd.collect())
    docs, sequences = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    stream = [p for s in sorted(sequences) for p in sorted(sequences[s], key=lambda p: p.offset)]
    for s, own in sequences.items():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.concatenate(([0], np.cumsum([p.length for p in own])))[:-1].tolist()
        assert sum(p.length for p in own) == 2048 or s == max(sequences)
    got, held = [], b""
    for p in stream:
        held = bytes(p.ids) if p.start == 0 else held + bytes(p.ids)
        if p.start + p.length == p.doc_tokens:
            got.append(held)
    assert sorted(got) == want
    assert curve_pack.packed(none, WORD).count() == 0 and not docs


def test_hilbert_curve_visits_neighbours():
    points = np.array(list(itertools.product(range(8), repeat=2)))
    keys = curve_pack.hilbert(points, bits=3)
    assert sorted(keys.tolist()) == list(range(64))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute_force_kept(texts):
    split = [[w for w in (t or "").encode().split()] for t in texts]
    seen = {}
    for w in split:
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    out = []
    for w in split:
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        out.append(b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


@pytest.mark.parametrize("hot", [2, 2_000])
def test_substring_dedup(spark, odd, none, hot, monkeypatch):
    monkeypatch.setattr(superkmer.repeated_places, "__defaults__", (hot,))
    got = sorted(r.kept for r in superkmer.without_repeats(odd).collect())
    assert got == sorted(brute_force_kept([r.text for r in odd.collect()]))
    assert superkmer.cleaned(odd).columns == odd.columns
    assert superkmer.without_repeats(none).count() == 0


def test_fingerprints(spark, sf_dir, odd, none):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd.filter("doc_id <> 3")):
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -(r.doc_id if r.doc_id is not None else -1))
        got = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
        assert len(got) == len(rows)
        prints = {}
        for k, r in enumerate(rows):
            text, after = r.text or "", rows[(k + 1) % len(rows)].text or ""
            n = len(text)
            edited = text[: n - n // 3] + after[: n // 3]
            assert (got[r.doc_id].n_chars, got[r.doc_id].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
            prints.setdefault(text, set()).add(got[r.doc_id].fingerprint)
        assert all(len(x) == 1 for x in prints.values())
    near = [(r.near_edited, r.near_next) for r in imatch.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()]
    assert sum(a > b for a, b in near) > 0.9 * len(near) and all(0 <= x <= 1 for p in near for x in p)
    assert imatch.fingerprints(none).count() == 0


def test_short_texts_with_little_in_common_have_different_fingerprints(spark):
    rng, words = random.Random(7), [f"word{k}" for k in range(100)]
    texts = [" ".join(rng.sample(words, k=3 + k % 4)) for k in range(300)]
    got = imatch.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    held = {}
    for r in got:
        held.setdefault(r.fingerprint, set()).add(frozenset(texts[r.doc_id].split()))
    assert all(len(x) == 1 for x in held.values())
    shared = {k: frozenset(t.split()) for k, t in enumerate(texts)}
    assert all(r.near_next < 1 for r in got if shared[r.doc_id] != shared[(r.doc_id - 1) % 300])


def test_quality(spark, sf_dir, odd, none):
    got = {r.doc_id: r for r in QUERIES["op9_line_crf"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert sum(p == q for p, q in held) >= 0.9 * len(held)
    few = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 7)], "doc_id long, label int")
    assert line_crf.fit(odd, few) == {"share": 1.0}
    assert {r.s for r in line_crf.scored(odd, line_crf.fit(odd, few.limit(0)), "s").collect()} == {0.5}
    model = line_crf.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), line_crf.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert line_crf.scored(odd, model).count() == odd.count() and line_crf.scored(none, model).count() == 0


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    unary, link = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    starts = np.array([0, 4, 5, 9])
    got, _ = line_crf.marginals(unary, link, line_crf._ordered(starts))
    for a, b in zip(starts[:-1], starts[1:]):
        total, sums = 0.0, np.zeros((b - a, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(unary[a + t, k] for t, k in enumerate(y)) + sum(link[i, j] for i, j in zip(y, y[1:])))
            total += w
            sums[np.arange(b - a), list(y)] += w
        assert np.allclose(got[a:b], sums / total)


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, -1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (None, [9.0, 9.0]), (5, []), (6, [1.0, 2.0, 3.0]), (7, [2.0, 0.0])]
    whole = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")))
    got = topk.top_k(whole.filter("id % 50 = 0"), whole, 2, tile_rows=1, shard_rows=1).collect()
    v = {0: (256, 512), 50: (256, -256), 1: (128, 128), 7: (512, 0)}
    want = []
    for q in (0, 50):
        scores = sorted((-(v[q][0] * v[c][0] + v[q][1] * v[c][1]), c) for c in (0, 50, 1, 1, 7) if c != q)
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:2])]
    assert sorted(map(tuple, got)) == want
    assert topk.top_k(whole.limit(0), whole.limit(0), 2).count() == 0


def test_top_k_of_repeated_query_ids(spark, tmp_path):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), *[(k, [k / 16, 1 - k / 32]) for k in range(1, 13)], (100, [0.5, 0.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    whole = [(k, [math.floor(256 * x) for x in v]) for k, v in rows]
    want = []
    for q in (50, 100):
        pairs = sorted((-sum(x * y for x, y in zip(a, b)), c) for i, a in whole if i == q for c, b in whole if c != q)
        want += [(q, k + 1, c, -score) for k, (score, c) in enumerate(pairs[:5])]
    got = QUERIES["op10_exact_topk"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def test_pipeline_stages(spark, sf_dir, odd, none):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "repeated_passages", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    pieces = QUERIES["pipeline"](spark, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, none, sf_dir).collect()


