"""Toxicity, ranked search and word runs: odd rows, brute force, held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from buildlens.llm import lexical_search, toxicity, word_runs
from buildlens.llm.catalog import registered

QUERIES, SQL = registered()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def prose(seed, n, words="the of and reading water stone over under mountain river quick slow light dark seven"):
    rng = random.Random(seed)
    return " ".join(rng.choice(words.split()) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing extra columns."""
    copy = prose(2, 60)
    rows = [
        (1, copy, "en", "a", 5), (2, copy, "en", "a", 5), (3, copy, None, None, None), (3, copy, None, None, None), (4, None, None, "b", None),
        (5, "", "en", "b", 0), (6, prose(1, 30_000), "en", "c", 1), (7, " \n\t ", "en", "c", 1), (None, "no id here, seven mountains.", "en", "c", 1),
        (9, "x\x00y   z  世界 é Éa", "en", "c", 1), (10, "be " * 200, "en", "c", 1), (11, prose(3, 60) + " " + copy, "en", "c", 1), (None, copy, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS runs", "'clash' AS _key", "'clash' AS _octave", "'clash' AS _features", "'clash' AS digest", "'clash' AS nth")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- word runs


def runs_of(words, least=12):
    """All runs (start, end, period), from their definition."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                own = words[i : j + q]
                if not any(own[d:] == own[:-d] for d in range(1, q)):
                    out.add((i, j + q, q))
            i = j + 1
    return out


def periodic(rng, n, kinds):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        a, b = sorted((rng.randrange(n + 1), rng.randrange(n + 1)))
        p = rng.randint(1, max(1, (b - a) // 2))
        for i in range(a + p, b):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("tile_words,cells", [(4096, 1 << 22), (24, 64)])
def test_runs_of_random_sequences(monkeypatch, tile_words, cells):
    monkeypatch.setattr(word_runs, "TILE_WORDS", tile_words)
    monkeypatch.setattr(word_runs, "CELLS", cells)
    rng = random.Random(tile_words)
    for _ in range(200):
        texts = [periodic(rng, rng.randrange(1, 140), rng.choice([1, 2, 3, 50])) for _ in range(2)]
        codes = np.array([w for t in texts for w in t], np.int64)
        starts = np.array([0, len(texts[0]), len(codes)])
        parts = [[], []]
        for row, octave, offset, words in word_runs.tiles(codes, starts):
            parts[row] += [(q, s + offset, e + offset) for s, e, q in word_runs.solved(words.astype(np.uint64), octave)]
        for text, part in zip(texts, parts):
            got = []
            for q, s, e in sorted(part):
                if got and got[-1][2] == q and s <= got[-1][1] - q:
                    got[-1] = (got[-1][0], max(got[-1][1], e), q)
                else:
                    got.append((s, e, q))
            assert set(got) == runs_of(text), text


def summary(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    h, n = (1 if doc_id is None else zlib.crc32(str(doc_id).encode())), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted((s, e - s, q) for s, e, q in runs_of(words))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(kept))]
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], *sha)


def test_op13_against_brute_force(spark, sf_dir):
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6_000]
    ids = {r.doc_id for r in docs}
    got = sorted(tuple(r) for r in QUERIES["op13_word_runs"](spark, sf_dir).collect() if r.doc_id in ids)
    assert got == sorted(summary(r.doc_id, r.text) for r in docs)


def test_runs_of_odd_rows(spark, odd, none):
    got = word_runs.with_runs(odd).collect()
    assert len(got) == odd.count()
    assert set(got[0].asDict()) == {*odd.columns, "n_words", "collapsed"}
    be = next(r for r in got if r.doc_id == 10)
    assert [tuple(x) for x in be.runs] == [(0, 200, 1)] and be.collapsed == "be" and be._key == "clash" and be._octave == "clash"
    assert [(r.n_words, r.runs, r.collapsed) for r in got if r.doc_id in (4, 5, 7)] == [(0, [], "")] * 3
    assert next(r for r in got if r.doc_id == 9).collapsed == "x\x00y z 世界 é Éa"
    assert word_runs.with_runs(none).count() == 0


def test_one_long_text_of_a_run(spark):
    words = [f"w{k}" for k in range(9_001)]
    text = " ".join(["begin", *(words * 7)[:60_000], "end"])
    row = word_runs.with_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(1, 60_000, 9_001)] and row.n_words == 60_002
    assert row.collapsed == " ".join(["begin", *words, "end"])


# --- ranked search


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def ranked(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return Counter(out)


@pytest.mark.parametrize("places,first,block", [(1 << 16, 32, 200_000), (64, 2, 20)])
def test_search_against_brute_force(spark, odd, monkeypatch, places, first, block):
    """With few places, few first texts and small blocks too, where bounds are loose."""
    for name, value in (("COORDINATES", places), ("FIRST", first), ("BLOCK_TERMS", block)):
        monkeypatch.setattr(lexical_search, name, value)
    items = [(1, "Mountain RIVER seven"), (2, None), (3, ""), (4, "nothing of this kind"), (5, "世界 éa be"), (6, prose(3, 40)), (7, "seven"), (None, "x y")]
    got = lexical_search.ranked(odd, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == ranked([(r.doc_id, r.text) for r in odd.collect()], items)


def test_search_in_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "seven")], "item_id long, text string")
    assert lexical_search.ranked(none, items).count() == 0
    assert lexical_search.ranked(odd, items.limit(0)).count() == 0


def test_terms_and_counts():
    texts = [prose(k, 80) for k in range(20)] + ["", "a-b A", "É\x00é"]
    codes, starts, distinct = lexical_search.terms_of(pa.array(texts))
    names = distinct.to_pylist()
    assert [[names[c] for c in codes[a:b]] for a, b in zip(starts[:-1], starts[1:])] == [terms(t) for t in texts]
    row, term, times = lexical_search.counted(codes, starts, len(names))
    assert [Counter({names[t]: n for r, t, n in zip(row, term, times.tolist()) if r == k}) for k in range(len(texts))] == [Counter(terms(t)) for t in texts]


# --- toxicity


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op11_toxicity"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in held) and sum(r.held_out for r in got.values()) < len(got) / 2
    assert sum(got[r.doc_id].predicted == r.toxic for r in held) >= 0.93 * len(held)
    clean = [r for r in held if r.toxic == 0]
    assert sum(got[r.doc_id].predicted for r in clean) <= 0.03 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (1, 1), (4, 1), (None, 1), (6, None), (7, 3), (11, 0)], "doc_id long, label int")
    got = toxicity.scored(odd, toxicity.fit(odd, labels))
    assert got.columns == [*odd.columns, "toxicity"] and got.count() == odd.count()
    assert len({r.toxicity for r in got.collect() if r.text == odd.first().text}) == 1
    assert {r.toxicity for r in toxicity.scored(odd, toxicity.fit(odd, labels.filter("label = 0"))).collect()} == {0.0}
    assert {r.toxicity for r in toxicity.scored(odd, toxicity.fit(odd, labels.limit(0))).collect()} == {0.5}
    assert toxicity.scored(none, toxicity.fit(odd, labels)).count() == 0


def test_features_of_hidden_words():
    lexicon = toxicity.Lexicon({"awful": 3.0, "awf*": 2.0})
    x = toxicity.features(pa.array(["you are aw*ful", "AWFUL!!", "awwwful day", "", "(all is) well", "@wful lot"]), lexicon)
    of = {n: x[:, k] for k, n in enumerate(toxicity.FEATURES)}
    assert (of["lexicon count"] > 0).tolist() == [True, True, True, False, False, True]
    assert (of["hidden lexicon words"] > 0).tolist() == [True, False, True, False, False, True]
    assert (of["hidden words"] > 0).tolist() == [True, False, True, False, False, True]
    assert (of["lexicon near second person"] > 0).tolist() == [True, False, False, False, False, False]
    assert of["words in capitals"][1] == 1 and of["exclamations"][1] == 2 and (x[3] == 0).all()


# --- earlier operators


def test_scores_beyond_64_bits_raise(spark):
    from pyspark.errors import PySparkException

    from buildlens.llm import topk

    def best(*rows):
        v = topk.whole_vectors(spark.createDataFrame(list(rows), "vec_id long, embedding array<double>"))
        return {(r.query_id, r.vec_id): r.score for r in topk.top_k(v, v, 5).collect()}

    assert best((0, [2.0**30, 3.0]), (1, [-(2.0**15), 1.0]))[0, 1] == -(2**61) + 3 * 65536
    # the sum of two large products that cancel fits
    assert best((0, [2.0**26, 2.0**26]), (1, [2.0**26, -(2.0**26)]))[0, 1] == 0
    for rows in (((0, [2.0**30, 0.0]), (1, [2.0**30, 1.0])), ((0, [1e18, 1.0]), (1, [1e18, 1.0]))):
        with pytest.raises(PySparkException, match="beyond 64 bits"):
            best(*rows)


def test_clashing_names(spark, odd):
    from buildlens.llm import interleave, line_crf, superkmer

    own = ["_bin", "_rows", "_all", "own_bin", "_shard", "shard", "kept", "n_words", "_quality_score", "_text_hash", "_copies"]
    docs = odd.selectExpr("doc_id", "text", "source", *[f"'x' AS {c}" for c in own])
    got = interleave.interleaved(docs, shards=4)
    assert sorted(got.columns) == sorted([*docs.columns, "slot"]) and {r["_bin"] for r in got.collect()} == {"x"}
    assert sorted(r.shard for r in got.collect()) == sorted(k * 4 // 13 for k in range(13))
    got = superkmer.without_repeats(docs)
    assert sorted(got.columns) == sorted([*docs.columns, "n_removed"]) and got.count() == 13
    assert superkmer.cleaned(docs).columns == docs.columns and {r.kept for r in superkmer.cleaned(docs).collect()} == {"x"}
    labels = spark.createDataFrame([(1, 1), (10, 0)], "doc_id long, quality int")
    assert line_crf.good_documents(docs, labels).columns == docs.columns


def test_fused_evidence_against_plain_python(spark):
    """Markup, suffix and host speak too; the text's own likelihoods are taken as they are."""
    from buildlens.llm import evidence_language as E

    words = {"en": "the of and reading water stone".split(), "de": "der und die wasser stein lesen".split(), "fr": "le et la eau pierre lire".split()}
    rng = random.Random(4)
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    labelled = spark.createDataFrame([(text(lang, 20) + f" {k}", lang) for lang in words for k in range(30)], "text string, lang string")
    model = E.fit_text_model(labelled)
    rows = []
    for k in range(60):
        lang = rng.choice(list(words))
        rows.append((k, text(lang, rng.choice([0, 1, 2, 12])), rng.choice([lang, lang, "xx", None, ""]), rng.choice([lang, "com", None]), f"{lang}{rng.randrange(3)}.org"))
    df = spark.createDataFrame(rows, "id long, text string, markup string, suffix string, host string")
    ll = {r.id: (r.ll, r.alone) for r in E.text_likelihoods(df, model).collect()}
    names = [*model["names"], E.UNKNOWN]
    n, N = len(names), len(rows)
    sums = lambda at, v: [sum(ll[r[0]][1][k] for r in rows if r[at] == v) for k in range(n)] if v else [0.0] * n
    size = lambda at, v: sum(r[at] == v for r in rows) if v else 0
    base = [(sum(a[k] for _, a in ll.values()) + 1 / n) / (N + 1) for k in range(n)]
    marks = {r[2] for r in rows if r[2]}
    says_all = [sum(sums(2, m)[k] for m in marks) + E.DECLARED_START * (len(marks) + 1) for k in range(n)]
    want = {}
    for r in rows:
        own, alone = ll[r[0]]
        logs = []
        for k in range(n):
            def share(at, outer):
                return (max(sums(at, r[at])[k] - (alone[k] if r[at] else 0), 0) + E.DRAW * outer) / ((size(at, r[at]) - 1 if r[at] else 0) + E.DRAW)

            log = own[k] + math.log(share(4, share(3, base[k])))
            if r[2]:
                log += math.log((max(sums(2, r[2])[k] - alone[k], 0) + E.DECLARED_START) / says_all[k])
            logs.append(log)
        top = max(logs)
        want[r[0]] = (names[logs.index(top)], 1 / sum(math.exp(x - top) for x in logs))
    got = {r.id: (r.language, r.posterior) for r in E.identified(df, model).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert [(k, rows[k], got[k], want[k]) for k in want if got[k][1] != pytest.approx(want[k][1], rel=1e-6)] == []


def test_language_of_rows_that_were_not_fitted(spark):
    from buildlens.llm import evidence_language as E

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = docs.withColumn("lang", __import__("pyspark").sql.functions.expr("CASE WHEN doc_id % 2 = 0 THEN lang END"))
    truth = {r.doc_id: r.lang for r in docs.filter("doc_id % 2 = 1 AND length(text) > 40").collect()}
    model = E.fit_text_model(seen.filter("lang IS NOT NULL"))
    got = {r.id: r.language for r in E.identified(E.document_evidence(docs), model).collect()}
    assert sum(got[k] == v for k, v in truth.items()) >= 0.98 * len(truth)
