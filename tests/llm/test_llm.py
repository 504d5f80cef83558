"""The ten operators against brute force, round trips and held-out rows, and on edge cases."""

import hashlib
import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planspark.llm import bpe, chat, html_text, language_id, packing, quality, queries, simhash, toxicity, url_filter, webp

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, label string, fp string, n int, task string"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, and columns with names used inside."""
    long = "the same words and others " * 8000
    rows = [(1, None, "en", "x", "a", 1, "t"), (2, "", None, None, None, None, None), (3, " \n\t ", "de", "x", "a", 1, "t"), (4, long, "en", "x", "a", 1, "t"), (None, "words of a row without id", "en", "x", "a", 1, "t"), (6, "12 34 !!", "fr", "x", "a", 1, "t")]
    rows += [(7, "the quick brown fox jumps over the lazy dog", "en", "x", "a", 1, "t")] * 3 + [(8, "der schnelle braune fuchs springt über den faulen hund", "de", "x", "a", 1, "t")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_language_edges(spark, edge, nothing):
    model = language_id.fit(edge)
    rows = language_id.identify(edge, model).collect()
    assert len(rows) == 10
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 6))
    assert {r.lang_pred for r in rows if r.doc_id == 8} == {"de"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert language_id.identify(nothing, language_id.fit(nothing)).count() == 0
    assert {r.lang_pred for r in language_id.identify(edge, language_id.fit(nothing)).collect()} == {"und"}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = queries.op1_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97


@pytest.mark.parametrize("text", ["😀😀", "𝟘𝟙 12", "½ ² ٣ _ — !", "🇩🇪 ☕", "\U0001F600\u0301", ""])
def test_no_letters_no_language(spark, text):
    model = language_id.fit(spark.createDataFrame([(1, "some words of a language", "en"), (2, "andere wörter einer sprache", "de")], "doc_id long, text string, lang string"))
    assert model.predict([text])[0] == ["und"] and model.predict([text])[1][0] == 0


def test_language_beyond_latin(spark):
    """Scripts whose letters a folded alphabet would mix up, also above the basic plane and without blanks."""
    rows = [("ja", "これは日本語の文章です"), ("zh", "这是一个中文句子我们在这里"), ("ru", "это русский текст для проверки"), ("uk", "це український текст для перевірки"), ("got", "𐌰𐍄𐍄𐌰 𐌿𐌽𐍃𐌰𐍂"), ("ar", "هذا نص عربي")]
    docs = spark.createDataFrame([(i, t, lg) for i, (lg, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.predict(["русский это", "український це", "日本語です", "中文我们", "𐌿𐌽𐍃𐌰𐍂", "عربي", "x" * 100_000])[0][:6] == ["ru", "uk", "ja", "zh", "got", "ar"]


def _kneser_ney(words, gram):
    """Probability of the last symbol of a gram after the others, straight from the definition."""
    counts = {}
    for w in words:
        padded = "\0\0\0" + w + "\0"
        for i in range(3, len(padded)):
            counts[padded[i - 3 : i + 1]] = counts.get(padded[i - 3 : i + 1], 0) + 1
    levels = {4: counts}
    for k in (3, 2, 1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1

    def p(g):
        level = levels[len(g)]
        if len(g) == 1:
            return (level.get(g, 0) + 0.5) / (sum(level.values()) + 0.5 * (len(level) + 1))
        once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.75
        after = [n for h, n in level.items() if h[:-1] == g[:-1]]
        if not after:
            return p(g[1:])
        return max(level.get(g, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * p(g[1:])

    return p(gram)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abcд日", min_size=1, max_size=6), min_size=1, max_size=30), st.text(alphabet="abcдё日", min_size=1, max_size=6))
def test_kneser_ney_brute_force(words, asked):
    grams, _ = language_id.grams_of(words)
    keys, n = np.unique(grams, return_counts=True)
    model = language_id.LanguageModels({"x": (keys, n)})
    padded = "\0\0\0" + asked + "\0"
    want = [_kneser_ney(words, padded[i - 3 : i + 1]) for i in range(3, len(padded))]
    got, _ = language_id.grams_of([asked])
    assert model.models[0].probabilities(got) == pytest.approx(want, rel=1e-5)
    assert model.cross_entropies([asked + " " + asked])[0][0, 0] == pytest.approx(-np.log(want).mean(), rel=1e-5)


def test_language_sample_is_bounded(spark):
    """A hot id gives one calibration row, whatever its number of rows."""
    seen = []
    hook = language_id.LanguageModels.calibrate
    try:
        language_id.LanguageModels.calibrate = lambda self, e, t: seen.append(len(t))
        language_id.fit(spark.createDataFrame([(1, "some words", "en")] * 500 + [(2, "andere worte", "de")], "doc_id long, text string, lang string"), calibration_rows=10)
    finally:
        language_id.LanguageModels.calibrate = hook
    assert seen[0] <= 10


def test_packing_is_whole(spark, edge, nothing):
    path = queries.tokenizer_file("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    docs = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    rows = packing.pack(docs, path, max_tokens=64).collect()
    assert {r.doc_id for r in rows} == set(ids)
    for doc, own in itertools.groupby(sorted(rows, key=lambda r: (r.doc_id, r.start)), key=lambda r: r.doc_id):
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack(edge, path).count() >= 10
    assert packing.pack(nothing, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    got = {}
    for lengths, count in packing.pack_histogram(histogram, 64):
        assert sum(lengths) <= 64
        for n in lengths:
            got[n] = got.get(n, 0) + count
    assert got == histogram


def test_word_encoder_is_exact():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing._word_encoder(path)
    for t in ["It's A\tTest, isn't it?!", "ΑΣ ΟΔΟΣ. İx", "e\u0301 é ﬁ ½", "a\x1cb\x0bc\u00a0d", "x<|endoftext|>y", "  two  blanks\r\n", "日本語 текст ...!!", ""]:
        assert np.frombuffer(encode([t])[0], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_quality_counts(spark, edge, nothing):
    rows = quality.judge(edge, quality.fit(edge, labels(spark))).collect()
    assert len(rows) == 10
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert quality.judge(nothing, quality.fit(nothing, labels(spark))).count() == 0
    m = quality.measure("a b c\na b c\n#x é\n\na b c d")
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == (12, 13, 1, 1, 9)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
def test_repeated_words_brute_force(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    assert quality.repeated_words(words) == len(covered)


def test_viterbi_brute_force():
    rng = np.random.default_rng(3)
    field = quality.LineField()
    field.emit, field.move, field.fitted = rng.normal(size=field.emit.shape), rng.normal(size=(2, 2)), True
    texts = [rng.random((n, len(quality.FEATURES))) > 0.5 for n in (5, 1, 0, 7, 5, 11, 12)]
    for x, path in zip(texts, field.viterbi(texts), strict=True):
        score = lambda p: sum(x[t] @ field.emit[:, s] for t, s in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        if len(x):
            assert tuple(path) == max(itertools.product((0, 1), repeat=len(x)), key=score)


def test_marginals_brute_force():
    rng = np.random.default_rng(6)
    field = quality.LineField()
    field.emit, field.move = rng.normal(size=field.emit.shape), rng.normal(size=(2, 2))
    texts = [rng.random((n, len(quality.FEATURES))) > 0.5 for n in (4, 1, 10, 2)]
    lengths = np.array([len(t) for t in texts])
    one, two = field._marginals(np.concatenate(texts) @ field.emit, quality.Segments(lengths), lengths)
    for x, end in zip(texts, np.cumsum(lengths), strict=True):
        paths = list(itertools.product((0, 1), repeat=len(x)))
        weight = np.array([np.exp(sum(x[t] @ field.emit[:, s] for t, s in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths])
        weight /= weight.sum()
        for t in range(len(x)):
            at = end - len(x) + t
            assert one[at, 1] == pytest.approx(sum(w for p, w in zip(paths, weight, strict=True) if p[t]))
            if t + 1 < len(x):
                assert two[at, 0, 1] == pytest.approx(sum(w for p, w in zip(paths, weight, strict=True) if (p[t], p[t + 1]) == (0, 1)))


def test_very_many_lines():
    """A million lines are decoded in a few thousand steps, and give the path of line-by-line decoding."""
    rng = np.random.default_rng(7)
    field = quality.LineField()
    field.emit, field.move, field.fitted = rng.normal(size=field.emit.shape), rng.normal(size=(2, 2)) + np.eye(2), True
    x = rng.random((200_000, len(quality.FEATURES))) > 0.5
    score, back = x @ field.emit, []
    best = score[0].tolist()
    (m00, m01), (m10, m11) = field.move.tolist()
    for s0, s1 in score[1:].tolist():
        a, b, c, d = best[0] + m00, best[1] + m10, best[0] + m01, best[1] + m11
        back.append((int(b > a), int(d > c)))
        best = [max(a, b) + s0, max(c, d) + s1]
    state, path = int(best[1] > best[0]), []
    for k in range(len(x) - 1, -1, -1):
        path.append(state)
        state = back[k - 1][state] if k else 0
    assert field.viterbi([x])[0].tolist() == path[::-1]


def test_labelled_sample_is_bounded(spark):
    """A hot id gives one learned row, whatever its number of rows."""
    docs = spark.createDataFrame([(1, f"line {k}\nanother one") for k in range(3000)] + [(2, "## $$ || ** !!")], "doc_id long, text string")
    marks = labels(spark, [(1, 1, 1), (2, 0, 0)])
    seen = []
    hooks = quality.LineField.fit, toxicity.isotonic
    try:
        quality.LineField.fit = lambda self, texts, y: seen.append(len(texts)) or self
        toxicity.isotonic = lambda x, y: seen.append(len(x)) or hooks[1](x, y)
        quality.fit(docs, marks)
        toxicity.fit(docs, marks)
    finally:
        quality.LineField.fit, toxicity.isotonic = hooks
    assert seen == [2, 2]


def _trees_by_hand(x, y, toxic_rate):
    """Margins of boosted trees of depth 1 over one binary feature, from the definition."""
    margin = np.full(len(y), np.log(toxic_rate / (1 - toxic_rate)))
    for _ in range(toxicity.TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        for v in (0, 1):
            at = x == v
            margin[at] -= toxicity.RATE * g[at].sum() / (h[at].sum() + toxicity.RIDGE)
    return margin


def test_boosted_trees_brute_force():
    """With one binary feature every tree is the best single split, whatever its depth."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, 300)
    y = (rng.random(300) < np.where(x, 0.8, 0.1)).astype(float)
    trees = toxicity.BoostedTrees().fit(x[:, None].astype(float), y)
    assert trees.margins(x[:, None].astype(float)) == pytest.approx(_trees_by_hand(x, y, y.mean()), rel=1e-6)


def test_isotonic_brute_force():
    """The pooled fit is the least-squares one among all monotone step functions (min-max formula)."""
    rng = np.random.default_rng(3)
    x, y = np.arange(12.0), rng.integers(0, 2, 12).astype(float)
    at, level = toxicity.isotonic(x, y)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
    assert np.interp(x, at, level) == pytest.approx(want, abs=0.02)


def test_toxicity_features_by_hand():
    got = dict(zip(toxicity.FEATURES, toxicity.features(["You are a BADword! b4dword zz"], {"badw": 6.0})[0], strict=True))
    assert (got["hits"], got["distinct_hits"], got["strong_hits"], got["near_second_person"], got["masked_hits"]) == (1, 1, 1, 1, 1)
    assert got["hits_per_word"] == pytest.approx(1 / 6) and got["second_person_rate"] == pytest.approx(1 / 6) and got["capital_rate"] == pytest.approx(4 / 29)


def test_quality_verdicts_follow_labels(spark):
    d = "/root/testdata/sf0.01"
    found = queries.op3_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in found]) > 0.95


def test_toxicity(spark, edge, nothing):
    rows = toxicity.score(edge, toxicity.fit(edge, labels(spark))).collect()
    assert len(rows) == 10 and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity.score(nothing, toxicity.fit(nothing, labels(spark, [(1, 1, 1)]))).count() == 0
    d = "/root/testdata/sf0.01"
    found = queries.op4_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in found]) > 0.95


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    at, level = toxicity.isotonic(x, (x + rng.normal(size=500) > 0).astype(float))
    assert np.all(np.diff(at) >= 0) and np.all(np.diff(level) >= 0)


def _fingerprint(text, width):
    import xxhash

    raw = (text or "").encode()
    words = "".join(chr(c + 32) if 65 <= c <= 90 else chr(c) for c in raw).encode("latin-1").split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [2048, 16])
def test_simhash_brute_force(spark, edge, nothing, monkeypatch, block):
    """Whole cells, and cells of many blocks, give the components of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    assert simhash.near_duplicates(nothing).count() == 0
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(30)]
    for t in list(texts[:12]):
        for k in range(60):
            own = t.split()
            own[rng.integers(400)] = f"v{k % 40}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    fps = [_fingerprint(t, 4) for t in texts]
    want = _components(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(want))
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}


@pytest.mark.parametrize("bits", [4, 5, 6])
@pytest.mark.parametrize("block", [2048, 32])
def test_grid_is_complete(spark, monkeypatch, bits, block):
    """Every link up to ``bits`` is found: pairs at exactly that distance, and a crowded group."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(bits)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    fps = set(base)
    for x in base:
        for _ in range(3):
            y = x
            for b in rng.choice(64, bits, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    for _ in range(150):
        y = base[0]
        for b in rng.choice(64, int(rng.integers(1, 9)), replace=False):
            y ^= 1 << int(b)
        fps.add(y)
    fps = sorted(fps)
    want = _components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= bits)
    signed = [simhash._signed(f) for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "p long"), bits)).collect()
    root = {f: f for f in signed} | {r.node: r.root for r in found}
    groups = lambda names: sorted(sorted(i for i, x in enumerate(names) if x == y) for y in set(names))
    assert groups([root[f] for f in signed]) == groups(want)


def test_keep_first_edges(spark, edge):
    kept = simhash.keep_first(edge, 5)
    assert kept.columns == edge.columns and kept.where("doc_id = 7").count() == 1 and kept.where("doc_id is null").count() == 1
    rows = [("b", "one two three four five six"), ("b", "seven eight nine ten eleven twelve"), ("a", "ONE two three four five six"), ("a", "ONE two three four five six"), ("c", "thirteen"), (None, "thirteen")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "name string, text string"), 5, "name").collect()
    assert sorted((r.name or "", r.text) for r in kept) == [("", "thirteen"), ("a", "ONE two three four five six"), ("b", "seven eight nine ten eleven twelve"), ("c", "thirteen")]


def test_keep_first_keeps_clashing_columns(spark):
    names = "doc_id long, text string, _hash string, id string, h string, p string, cell string, root string, _id string"
    rows = [(k, "some words of a text that comes again", "a", "b", "c", "d", "e", "f", "g") for k in (2, 1)] + [(3, "other words altogether in this one", None, None, None, None, None, None, None)]
    kept = simhash.keep_first(spark.createDataFrame(rows, names), 5)
    assert kept.columns == [n.split()[0] for n in names.split(", ")]
    assert sorted((r.doc_id, r._hash, r.id, r._id) for r in kept.collect()) == [(1, "a", "b", "g"), (3, None, None, None)]


@pytest.mark.parametrize("block", [2048, 24])
def test_keep_first_brute_force(spark, monkeypatch, block):
    """Groups of near copies whose members are partly similar: the components of all pairs of shingle sets."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(11)
    texts = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(150)]
        for _ in range(90):
            own = list(base)
            for at in rng.choice(150, int(rng.integers(1, 6)), replace=False):
                own[at] = f"x{rng.integers(10**9)}"
            texts.append(" ".join(own))
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = _components(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5).collect()}
    assert set(want) <= kept and len(kept) <= 1.02 * len(set(want)) + 1


def test_wide_grid_is_one_of_popcounts():
    """Cells name the counts of two-bit segments; unary codes give their Manhattan distance, a bound of the Hamming one."""
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 64, (60, 16), dtype=np.uint64)
    counts = np.array([[[(int(f) >> s & 3).bit_count() for s in range(0, 64, 2)] for f in row] for row in fps])
    far = np.abs(counts[:, None] - counts[None, :]).sum((2, 3))
    assert (simhash.differing(simhash.unary(fps)[:, None], simhash.unary(fps)[None, :]) == far).all()
    assert (far <= simhash.differing(fps[:, None], fps[None, :])).all()
    low = np.uint64(simhash._LOW)
    turned = ((fps & low) << np.uint64(1)) | ((fps >> np.uint64(1)) & low)  # other bits, the same counts
    assert (simhash.wide_cells(fps, 16, 64) == simhash.wide_cells(turned, 16, 64)).all()
    same = simhash.wide_cells(fps, 16, 64)[:, None] == simhash.wide_cells(fps, 16, 64)[None, :]
    own = counts.reshape(60, 64, 8)
    assert (same == (own[:, None] == own[None, :]).all(3)).all()


@pytest.mark.parametrize("held", [1 << 20, 500])
def test_large_runs_pass_on_the_nearest(monkeypatch, held):
    """A run whose near pairs are thinned on the way passes on what it does when it is thinned at the end."""
    monkeypatch.setattr(simhash, "_HELD", held)
    rng = np.random.default_rng(6)
    fps = np.repeat(rng.integers(0, 1 << 64, (1, 4), dtype=np.uint64), 700, 0)
    for k in range(4):
        fps[:, k] ^= np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)
    batch = pa.RecordBatch.from_pydict({"cell": np.zeros(700, np.int64), "block": np.zeros(700, np.int64), "p": np.arange(700)} | {f"f{k}": fps[:, k].view(np.int64) for k in range(4)})
    found = pa.Table.from_batches(simhash._candidates(iter([batch])))
    assert set(found["crowded"].to_pylist()) == {0} and found.num_rows <= 2 * 700
    far = simhash.differing(fps[:, None], fps[None, :]).astype(int) + 1000 * np.eye(700, dtype=int)
    nearest = {(min(i, int(j)), max(i, int(j))) for i, row in enumerate(far) for j in [row.argmin()] if (row == row.min()).sum() == 1}
    assert nearest <= set(zip(found["a"].to_pylist(), found["b"].to_pylist()))


@pytest.mark.parametrize("width", [16, 18])
def test_candidates_come_once(width):
    """A near pair comes from the first cell it shares, or that cell is crowded; a crowded run passes on a forest."""
    rng = np.random.default_rng(9)
    fps = np.repeat(rng.integers(0, 1 << 64, (1, 4), dtype=np.uint64), 400, 0)
    for _ in range(6):
        for k in range(4):
            fps[:, k] ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    tables = 256 // width
    cells = simhash.wide_cells(fps, width, tables)
    cell, p = cells.T.ravel(), np.tile(np.arange(400), tables)
    order = np.argsort(cell, kind="stable")
    batch = pa.RecordBatch.from_pydict({"cell": cell[order], "block": np.zeros(len(cell), np.int64), "p": p[order]} | {f"f{k}": fps[p[order], k].view(np.int64) for k in range(4)})
    found = pa.Table.from_batches(simhash._candidates(iter([batch]), width))
    pairs = list(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))
    assert len(pairs) == len(set(pairs))
    crowded = [c for c in found["crowded"].to_pylist() if c >= 0]
    size = dict(zip(*np.unique(cell, return_counts=True), strict=True))
    assert crowded and all(n < size[c] for c, n in zip(*np.unique(crowded, return_counts=True), strict=True))
    far = simhash.differing(fps[:, None], fps[None, :])
    a, b = np.nonzero(np.triu(far <= simhash.near_limit(4), 1) & (cells[:, None] == cells[None, :]).any(2))
    first = cells[a, (cells[a] == cells[b]).argmax(1)]
    passed, again = set(pairs), set(crowded)
    assert len(a) > 10_000 and all((i, j) in passed or c in again for i, j, c in zip(a.tolist(), b.tolist(), first.tolist(), strict=True))


def test_wide_grid_keeps_its_recall():
    for rows in (1, 10**6, 10**9, 10**11):
        width, tables, prints = simhash.wide_grid(rows)
        assert 1 - (1 - simhash.AGREE**width) ** tables >= 0.99 and tables * width <= 64 * prints and rows / 2**width <= 4096


def test_pipeline_links_shingle_similarity(spark):
    """Pairs just above similarity 0.8 are linked, pairs just below never, in small cells and in a large group."""
    rng = np.random.default_rng(8)
    texts, close = [], []

    def sets(t):
        words = t.split()
        return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}

    for k in range(200):
        words = [f"x{w}" for w in rng.integers(0, 10**9, 300)]
        other = list(words)
        n = 32 if k % 2 else 37  # of 296 shingles, 32 replaced leave similarity 0.805, 37 leave 0.778
        other[300 - n :] = [f"y{w}" for w in rng.integers(0, 10**9, n)]
        a, b = sets(" ".join(words)), sets(" ".join(other))
        close.append(len(a & b) >= 0.8 * len(a | b))
        texts += [" ".join(words), " ".join(other)]
    assert 90 <= sum(close) <= 110
    base = [f"z{w}" for w in rng.integers(0, 10**9, 300)]
    for k in range(1200):
        own = list(base)
        own[(k * 7) % 290 : (k * 7) % 290 + 3] = [f"q{k}a", f"q{k}b", f"q{k}c"]
        texts.append(" ".join(own))
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5).collect()}
    dropped = [2 * k + 1 not in kept for k in range(200)]
    assert not any(d for d, c in zip(dropped, close, strict=True) if not c)
    assert sum(dropped) >= 0.95 * sum(close)
    assert [i for i in kept if i >= 400] == [400]


def test_forest_connects_as_all_links_do():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, dtype=np.uint64)
    fp = np.unique(base ^ (np.uint64(1) << rng.integers(0, 8, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 12, 300).astype(np.uint64)))
    near = simhash._linked(fp[:, None], fp[None, :])
    np.fill_diagonal(near, False)
    links = set(simhash.tree(near))
    assert _components(len(fp), lambda i, j: near[i, j]) == _components(len(fp), lambda i, j: (i, j) in links or (j, i) in links)


def test_chat_links_and_validates(spark):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": {"b": 1, "a": "é"}}, {"id": "b", "name": "f", "arguments": {"a": 3}}, {"id": "c", "name": "g", "arguments": "{broken"}]}, ensure_ascii=False)
    rows = [(1, 0, "user", 'say "hi"\n'), (1, 1, "tool", '{"tool_call_id":"a","content":"early"}'), (1, 2, "assistant", call), (1, 3, "tool", '{"tool_call_id":"zz","content":null}'), (1, 4, None, None), (1, 5, "user", ""), (1, 5, "user", ""), (None, None, "user", "{not json")]
    messages = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, calls string, result int")
    found = chat.format_messages(messages, {"f": {"a": ("string", True), "b": ("integer", False)}}).collect()
    assert len(found) == 8
    by = {r.turn: r for r in found}
    assert (by[1].order_turn, by[1].order_rank, by[1].linked) == (2, 1, True)
    assert by[3].linked is False and (by[2].n_calls, by[2].n_valid) == (3, 1)
    assert json.loads(by[0].message) == {"content": 'say "hi"\n', "role": "user"}
    calls = json.loads(by[2].message)["tool_calls"]
    assert calls[0] == {"arguments": {"a": "é", "b": 1}, "id": "a", "name": "f"} and calls[2]["arguments"] == "{broken"
    assert all(r.message == json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in found)
    assert chat.format_messages(messages.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DIR}/conversations.parquet'")
    ours, theirs = queries.queries()[name](spark, DIR), con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    got, want = sorted(map(repr, map(tuple, ours.select(*columns).collect()))), sorted(map(repr, theirs.fetchall()))
    assert got == want
    if name == "chat_tool_calls":
        rows = ours.collect()
        assert sum(r.n_calls for r in rows) and sum(r.n_valid for r in rows) and {r.linked for r in rows} == {None, True, False}


def _chat_by_hand(rows, tools):
    """The formatted messages of rows (conv, turn, role, text), with the json module."""

    def load(text):
        try:
            return json.loads(text)
        except (TypeError, ValueError):
            return None

    kinds = {"string": lambda v: isinstance(v, str), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool), "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict)}
    dump = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    first = {}
    for conv, turn, role, text in rows:
        for call in (load(text) or {}).get("tool_calls", []) if role == "assistant" else []:
            first[conv, call["id"]] = min(turn, first.get((conv, call["id"]), turn))
    out = []
    for conv, turn, role, text in rows:
        body, message, valid, at = load(text), {"role": role, "content": text}, 0, None
        calls = body["tool_calls"] if role == "assistant" and isinstance(body, dict) else []
        if calls:
            message["content"] = None
            message["tool_calls"] = calls
            for call in calls:
                args, schema = call["arguments"], tools.get(call["name"])
                valid += schema is not None and isinstance(args, dict) and set(args) <= set(schema) and all(kinds[k](args[a]) if a in args else not need for a, (k, need) in schema.items())
        linked = None
        if role == "tool" and isinstance(body, dict):
            message |= {"content": body["content"], "tool_call_id": body["tool_call_id"]}
            at = first.get((conv, body["tool_call_id"]))
            linked = at is not None
        out.append((conv, turn, max(turn, at) if at is not None else turn, int(at is not None), len(calls), valid, linked, dump(message)))
    return sorted(out, key=repr)


def test_chat_brute_force(spark):
    rng = np.random.default_rng(9)
    tools, rows = {"f": {"a": ("string", True), "b": ("integer", False)}, "g": {"x": ("number", True), "y": ("array", False), "z": ("object", False), "w": ("boolean", False)}}, []
    values = ["s", 3, 2.5, True, [1, "é"], {"k": 1}]
    for conv in range(25):
        for turn in range(12):
            kind = rng.integers(4)
            if kind == 0:
                calls = [{"id": f"c{rng.integers(6)}", "name": str(rng.choice(["f", "g", "h"])), "arguments": {str(k): values[rng.integers(6)] for k in rng.choice(list("abwxyz"), rng.integers(1, 4), replace=False)}} for _ in range(rng.integers(1, 4))]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls}, ensure_ascii=False)))
            elif kind == 1:
                rows.append((conv, turn, "tool", json.dumps({"content": f'result "{turn}"\n', "tool_call_id": f"c{rng.integers(8)}"})))
            else:
                rows.append((conv, turn, str(rng.choice(["user", "system"])), f"words\t{turn} é"))
    found = chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect()
    got = sorted(((r.conv_id, r.turn, r.order_turn, r.order_rank, r.n_calls, r.n_valid, r.linked, r.message) for r in found), key=repr)
    assert got == _chat_by_hand(rows, tools)


def test_url_rules_and_model(spark):
    rules = [url_filter.Rule.of(v, r) for v, r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))]
    urls = ["http://A.Example.NET/en/x?q", "https://example.net/de/", "http://net", "http://x.org/fr/1#t", "notanexample.net/en/", None, "", "http://example.com/de/z", "http://notexample.com/de/", "a://b://c/d"]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(rows, rules).collect()}
    assert [got[i].rule for i in range(10)] == ["example.net/en/", "net/", None, "org/fr/", None, None, None, "example.com/de/", None, None]
    assert (got[0].host, got[0].path, got[2].path, got[9].host, got[9].path) == ("a.example.net", "/en/x", "", "b:", "//c/d")
    assert all(got[i].verdict in ("allow", "block") for i in range(10))
    assert url_filter.judge(rows.limit(0), rules).count() == 0


def _witten_bell(texts, gram):
    """Probability of the last byte of a run after the others, straight from the definition."""
    runs = [(b"\0" * 4 + t)[i : i + 5] for t in texts for i in range(len(t))]

    def p(g):
        if not g:
            return 1 / 256
        after = [r[-len(g) :] for r in runs if r[-len(g) : -1] == g[:-1]]
        if not after:
            return p(g[1:])
        kinds = len(set(after))
        return (after.count(g) + kinds * p(g[1:])) / (len(after) + kinds)

    return p(gram)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab/é1", min_size=1, max_size=9), min_size=1, max_size=8), st.lists(st.text(alphabet="ab/1", min_size=1, max_size=9), min_size=1, max_size=8), st.text(alphabet="abc/é12", min_size=1, max_size=9))
def test_url_ratio_brute_force(good, bad, asked):
    models = []
    for urls in (good, bad):
        keys, n = np.unique(url_filter.grams_of(["http://" + u for u in urls])[0], return_counts=True)
        models.append(url_filter.witten_bell(keys, n, url_filter.BITS, url_filter.ORDER))
    raw = asked.encode()
    runs = [(b"\0" * 4 + raw)[i : i + 5] for i in range(len(raw))]
    want = np.mean([np.log(_witten_bell([u.encode() for u in good], r)) - np.log(_witten_bell([u.encode() for u in bad], r)) for r in runs])
    assert url_filter.RatioModel(*models).means(["x://" + asked, None, asked]) == pytest.approx([want, 0, want], rel=1e-4, abs=1e-5)


def test_url_models_tell_numbers_and_scripts_apart(spark):
    rules = [url_filter.Rule.of("allow", "good.org/"), url_filter.Rule.of("block", "bad.org/")]
    urls = [f"http://good.org/страница/17{k}" for k in range(30)] + [f"http://bad.org/товар/88{k}" for k in range(30)] + ["http://else.com/страница/171", "http://else.com/товар/881", "страница/17", "товар/88"]
    got = [r.verdict for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()]
    assert got[-4:] == ["allow", "block", "allow", "block"]


WEIRD = ["", " ", "a  b", "a \n b", "\n\n x", "it's you'll", "<|endoftext|> a <|endoftext|>", "a\xa0b\u2003 \u3000c", "x" * 500, "日本語 текст ١٢٣", "a\x1cb", " lead", "trail ", "\t\tq", "é" * 300, "a\u200bb", "½ ² x²"]


@pytest.fixture(scope="module")
def coder():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    vocabulary = bpe._vocabulary(path)
    words = [b" the", b" them", b"the", b" tion", b"ation", b" nation", "é".encode()]
    return Tokenizer.from_file(path), vocabulary, bpe.Codec(vocabulary, bpe.Lexicon.mapped(bpe.Lexicon.compile(words, vocabulary).to_bytes())), words


def test_lexicon_shares_suffixes(coder):
    _, vocabulary, codec, words = coder
    rank = codec.lexicon.walk([*words, b" th", b"", b"nation", b" themx"])
    assert sorted(rank[: len(words)]) == list(range(len(words))) and set(rank[len(words) :]) == {-1}
    assert all(np.frombuffer(codec.lexicon.ids_of(r), "<u4").tolist() == vocabulary.merge(w) for w, r in zip(words, rank, strict=False))
    assert len(codec.lexicon.final) < sum(map(len, words))


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\tab'stlé.,!1", max_size=60)))
def test_bpe_equals_library(coder, text):
    tokenizer, _, codec, _ = coder
    ids = codec.encode([text])[0].tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_fixed_cases(coder):
    tokenizer, vocabulary, codec, _ = coder
    assert [x.tolist() for x in codec.encode(WEIRD)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in WEIRD]
    words = ["lowercase".encode(), b"x" * 300, "日本".encode(), b"a", b""]
    assert [np.frombuffer(b, "<u4").tolist() for b in vocabulary.merge_many(words)] == [vocabulary.merge(w) for w in words]
    broken = tokenizer.encode("é", add_special_tokens=False).ids[:1] + vocabulary.merge(b"\xe2")
    assert codec.decode(broken) == tokenizer.decode(broken, skip_special_tokens=False)


def test_bpe_tables_of_a_codec_serve_whole_texts(coder):
    """Ids stay arrays: decimals and bytes are taken from tables that a codec makes once."""
    tokenizer, vocabulary, codec, _ = coder
    for ids, text in zip(codec.encode([*WEIRD, None, *WEIRD]), [*WEIRD, "", *WEIRD], strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert b",".join(codec.decimal[ids].tolist()) == ",".join(map(str, want)).encode()
        assert codec.decode(ids) == codec.decode(ids.tolist()) == tokenizer.decode(want, skip_special_tokens=False)
    assert len(codec.decimal) == len(codec.by_id) == len(vocabulary.bytes)


def test_bpe_tables(spark, edge, nothing):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    rows = bpe.digests(edge, path, bpe.build_lexicon(edge, path)).collect()
    assert len(rows) == 10 and all(r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for r in rows for t in [edge.where(F.col("doc_id").eqNullSafe(r.doc_id)).first().text])
    assert bpe.digests(nothing, path, bpe.build_lexicon(nothing, path)).count() == 0
    ids = bpe.encode(edge.where("doc_id = 8"), path, bpe.build_lexicon(edge, path))
    assert bpe.decode(ids, path, bpe.build_lexicon(edge, path)).first().text.startswith("der schnelle")


def _image(width, height, transforms, body):
    """A lossless bitstream; ``transforms`` and ``body`` write bits."""
    w = webp.BitWriter()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    transforms(w)
    w.put(0, 1)
    body(w)
    return w.value.to_bytes((w.size + 7) // 8, "little")


def _flat(w, argb, top=True, cache=0):
    """Every pixel the same colour, by single-symbol codes."""
    w.put(0, 1)
    if top:
        w.put(0, 1)
    for s in ((argb >> 8) & 255, (argb >> 16) & 255, argb & 255, argb >> 24):
        w.put_single(s)
    w.put_single(0)


def test_webp_transforms():
    flat = lambda argb: lambda w: _flat(w, argb)

    def predictor(w):
        w.put(1, 1)
        w.put(0, 2)
        w.put(0, 3)
        _flat(w, 1 << 8, top=False)  # mode 1: left

    _, _, p = webp.decode_argb(_image(3, 2, predictor, flat(0x00010203)))
    first = 0xFF010203
    assert p.tolist() == [first, 0xFF020406, 0xFF030609, 0xFF020406, 0xFF030609, 0xFF04080C]

    def green(w):
        w.put(1, 1)
        w.put(2, 2)

    assert webp.decode_argb(_image(2, 1, green, flat(0x01020304)))[2].tolist() == [0x01050307] * 2

    def cross(w):
        w.put(1, 1)
        w.put(1, 2)
        w.put(0, 3)
        _flat(w, 0x00002040, top=False)  # red-to-blue 0, green-to-blue 32, green-to-red 64

    assert webp.decode_argb(_image(1, 1, cross, flat(0x00000500)))[2].tolist() == [5 * 64 // 32 << 16 | 5 << 8 | 5 * 32 // 32]

    def palette(w):
        w.put(1, 1)
        w.put(3, 2)
        w.put(1, 8)  # two colours, eight pixels to one
        _flat(w, 0x10203040, top=False)

    # indices 1,1,0,... of green byte 0b00000011; colours are summed along the palette
    assert webp.decode_argb(_image(3, 1, palette, flat(0x00000300)))[2].tolist() == [0x20406080, 0x20406080, 0x10203040]


def test_webp_references_and_cache():
    def body(w):
        w.put(1, 1)
        w.put(1, 4)  # a cache of two colours
        w.put(0, 1)
        lengths = [0] * 282
        lengths[7] = lengths[256 + 4] = lengths[280] = lengths[281] = 2
        green = webp.Code(lengths)
        w.put_lengths(lengths)
        for s in (1, 2, 3):
            w.put_single(s)
        w.put_single(0)  # distance code 1: the pixel above
        w.put_code(green, 7)
        pixel = 3 << 24 | 1 << 16 | 7 << 8 | 2
        slot = (pixel * webp._COLOR_MULTIPLIER & 0xFFFFFFFF) >> 31
        w.put_code(green, 280 + slot)
        w.put_code(green, 256 + 4)
        w.put(1, 1)  # length 5 + 1
    _, _, p = webp.decode_argb(_image(1, 8, lambda w: None, body))
    assert p.tolist() == [3 << 24 | 1 << 16 | 7 << 8 | 2] * 8


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_webp_round_trip(data):
    payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
    media = webp.write(payload)
    assert webp.read_many([media, b"", media])[0][0] == payload
    stream, end = webp._chunk(media, 0)
    assert webp.samples(webp.decode_argb(stream)[2]) == payload and end == len(media)
    with pytest.raises(ValueError):
        webp.read_many([media[: len(media) // 2]])


@pytest.mark.parametrize("kind", ["words again", "one byte", "columns", "few colours", "zeros", "drift"])
def test_webp_forms(kind):
    """Payloads that repeat are stored shorter, by references, cache, palette or predictor, and read by the general reader."""
    rng = np.random.default_rng(1)
    line = bytes(rng.integers(97, 123, 52).tolist())
    payload = {
        "words again": line * 208, "one byte": b"x" * 6400, "zeros": b"\0" * 64,
        "columns": b"".join(line + bytes(rng.integers(97, 123, 12).tolist()) for _ in range(300)),
        "few colours": b"".join([b"abcd", b"efgh", b"ijkl"][k] for k in rng.integers(0, 3, 1600)),
        "drift": (np.arange(64, dtype=np.uint8)[None, :] + 3 * np.arange(400, dtype=np.uint8)[:, None]).tobytes(),
    }[kind]
    media = webp.write(payload)
    plain = len(webp._literals(np.frombuffer(payload[: 4 * 16 * 512], np.uint8)))
    stream, _ = webp._chunk(media, 0)
    assert webp.read_many([media])[0][0] == payload and len(stream) < plain and webp._plain_codes(stream) is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bc", b"a long word again ", b"\n", b"\xff\x00", b"0123456789abcdef"]), min_size=1, max_size=400))
def test_webp_repetitive_round_trip(words):
    payload = b"".join(words)
    payload += b"\0" * (-len(payload) % 64)
    assert webp.read_many([webp.write(payload)])[0][0] == payload


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 1 << 20))
def test_webp_prefix_values(value):
    symbol, extra, n = webp._prefix_of(value)
    assert webp._extended(webp.Bits(extra.to_bytes(8, "little")), symbol) == value and extra < 1 << n or not n


def test_webp_tables(spark, edge, nothing):
    rows = {r.doc_id: r for r in webp.digests(edge).collect()}
    assert rows[1].payload_bytes == 64 and rows[1].n_bytes == 0 and rows[4].payload_bytes % 64 == 0
    assert "images=7" in rows[4].feature
    back = webp.load(webp.store(edge.where("doc_id = 8"))).first()
    assert bytes(back.payload).rstrip(b"\0").decode() == "der schnelle braune fuchs springt über den faulen hund"
    assert webp.digests(nothing).count() == 0


PAGE = """<html><head><title>t</title></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>{main}<div class="sidebar-left">links</div>
<form>mail</form><div id="cookie-notice">ok?</div><section class="comments"><p>first!</p></section><script>var x="<p>no</p>";</script><footer>&copy; me</footer></body></html>"""


def _outside(page):
    own = html_text.lines_of(page)
    return [(t, r) for t, r in zip(own.text, own.region, strict=True) if r != 1]


def _text(page, *others):
    own, out = html_text.lines_of(page), _outside(page)
    keep, _ = html_text.decide([t for t, _ in out], [r for _, r in out], [[t for t, _ in _outside(o)] for o in others], 1 in own.region)
    return html_text.written([t.encode() for t in own.text], bytes(own.region), bytes(keep)).decode()


def test_html_regions():
    article = "<article><h1>Tom &amp; Co</h1><p><b>One\n  two<br>three<p>Four &lt;p&gt;<aside>ad</aside></article>"
    assert _text(PAGE.format(main=article)) == "Tom & Co\nOne two three\nFour <p>"
    assert _text(PAGE.format(main=article), PAGE.format(main=article)) == "Tom & Co\nOne two three\nFour <p>"
    plain = "<div>Welcome to us</div><p>{}</p><p>more {} words</p><div>All rights</div>"
    assert _text(PAGE.format(main=plain.format("own", "a")), PAGE.format(main=plain.format("other", "b"))) == "own\nmore a words"
    assert _text(None) == _text("") == _text("<p>") == ""


def test_html_alignment_decides(spark):
    """Free lines beside an article stay if no neighbour has them; large templates go; without an article, copies are told
    from templates by further neighbours."""
    lines = lambda *texts: "".join(f"<div>{t}</div>" for t in texts)
    template = [f"template {k}" for k in range(9)]
    teaser = "<article>teaser</article>"
    bodies = {1: "alpha", 2: "beta", 3: "copied story", 4: "copied story", 5: "gamma"}
    for card in ("", teaser):
        rows = [(i, f"http://a.b/{i}", card + lines(*template, f"{b} one", f"{b} two", f"only {i}")) for i, b in bodies.items()]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = {r.page_id: (r.text, r.n_shared) for r in html_text.extract(pages).collect()}
        head = "teaser\n" if card else ""
        story = lambda i, b: "" if card and i in (3, 4) else f"{b} one\n{b} two\n"  # noqa: E731, B023
        assert got == {i: (f"{head}{story(i, b)}only {i}", 9 if story(i, b) else 11) for i, b in bodies.items()}


def _lcs(a, b):
    """The lines of a longest common subsequence, where a longest one is unique."""
    best = [[()] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = (*best[i][j], i) if x == y else max(best[i][j + 1], best[i + 1][j], key=len)
    return best[-1][-1]


def _brute_force(pages):
    """Main text of pages {id: (url, html)}: every page against the two before and after it among its host's different pages."""
    lines = {i: html_text.lines_of(page) for i, (_, page) in pages.items()}
    place = {}
    for i, (url, _) in pages.items():
        host, _, path = url.partition("://")[2].partition("/")
        key = host, tuple(lines[i].text), tuple(lines[i].region)
        place[key] = min(place.get(key, "/" + path), "/" + path)
    out = {}
    for i, (url, _) in pages.items():
        host, own = url.partition("://")[2].partition("/")[0], lines[i]
        order = sorted((p, k) for k, p in place.items() if k[0] == host)
        at = [k for _, k in order].index((host, tuple(own.text), tuple(own.region)))
        near = [k for _, k in order[max(0, at - 2) : at] + order[at + 1 : at + 3]]
        free = [j for j, r in enumerate(own.region) if r != 1]
        other = [[t for t, r in zip(*k[1:], strict=True) if r != 1] for k in near]
        shared = [{free[j] for j in _lcs([own.text[j] for j in free], o)} for o in other]
        out[i] = "\n".join(t for j, (t, r) in enumerate(zip(own.text, own.region, strict=True)) if r == 1 or (r == 0 and sum(j in s for s in shared) <= (0 if 1 in own.region else len(near) / 2)))
    return out


@pytest.mark.parametrize("parts", [1, 7, 40, 200])
def test_html_brute_force(spark, parts, monkeypatch):
    """The same rows at any partitioning, with repeated pages, several hosts and stretches of a few pages."""
    monkeypatch.setattr(html_text, "STRETCH", 5)
    rng = np.random.default_rng(4)
    pages, rows = {}, []
    for i in range(60):
        host = f"h{i % 3}.com"
        body = "".join(f"<div>{x}</div>" for x in [f"top {host}", f"block {rng.integers(4)}", *[f"own {i} {k}" for k in range(rng.integers(1, 4))], f"foot {rng.integers(2)}"])
        card = "<article><p>card</p></article>" if i % 4 == 0 else ""
        pages[i] = f"http://{host}/{rng.integers(5)}/{i:02d}", card + body
    for i in (3, 11):  # copies of whole pages at other paths, and repeated rows
        pages[100 + i] = f"http://h{i % 3}.com/9/{i}", pages[i][1]
    rows = [(i, *p) for i, p in pages.items()] * 2
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = _brute_force(pages)
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    assert any("block" in t for t in want.values()) and not any("top" in t for t in want.values())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_lines_brute_force(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(html_text.shared(a, b)) == best[-1][-1]


def test_html_tables(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (3, "http://h/b", PAGE.format(main="<article><p>x</p></article>")), (3, "http://h/b", PAGE.format(main="<article><p>x</p></article>"))]
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, host string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from planspark.llm.common import materialize

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.collect()}
        kept = materialize(stage(spark, kept, DIR))
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= before
    packed = corpus_pipeline.run(spark, DIR)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_contract(spark, name):
    rows = queries.queries()[name](spark, DIR)
    if name == "chat_tool_calls":
        return  # held against SQL
    source = "conversations" if name.startswith("op6_") else "pages" if name.startswith(("op7_", "op10_")) else "documents"
    if not name.startswith("op2_"):
        assert rows.count() == spark.read.parquet(f"{DIR}/{source}.parquet").count()
