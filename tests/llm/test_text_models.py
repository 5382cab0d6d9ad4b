import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from kinlink.llm import bpe_dropout, bradley_terry, hpylm

TEXTS = ["Hello  world\nfoo bar", " lead", "", "a\tb é́ ﬁ Ⅷ \x00x", "trail  ", "x" * 500, "ab" * 300 + "  " + "é" * 60, "   many    spaces   ", "  ", "the quick brown fox jumps over the lazy dog " * 5, "日本語 テキスト", "▁ a▁b ▁▁"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe_dropout.load_vocabulary()


def test_without_dropout_equals_the_library(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=bpe_dropout.MODEL)
    tool = bpe_dropout.Segmenter(vocabulary, rate=0.0)
    plain = TEXTS[:-1]  # the library takes a literal U+2581 for a space
    for t, pieces in zip(plain, tool.encode(plain, list(range(len(plain))))):
        assert pieces.tolist() == sp.encode(t)


def test_dropout_is_lossless_seeded_and_varied(vocabulary):
    one, again, other = (bpe_dropout.Segmenter(vocabulary, 0.3, seed) for seed in (1, 1, 2))
    a, b, c = (s.encode(TEXTS, list(range(len(TEXTS)))) for s in (one, again, other))
    assert [one.decode(x) for x in a] == TEXTS
    assert all(np.array_equal(x, y) for x, y in zip(a, b))
    assert any(not np.array_equal(x, y) for x, y in zip(a, c))
    words = one.segment([" international"] * 4, np.arange(4))
    cut = np.cumsum(words[1])[:-1]
    assert len({tuple(x) for x in np.split(words[0], cut)}) > 1


def test_heap_and_rounds_agree(vocabulary):
    tool = bpe_dropout.Segmenter(vocabulary, 0.2)
    rng = random.Random(5)
    words = [" " + "".join(rng.choices("abcdeinorst", k=rng.randint(1, 30))) for _ in range(300)]
    base = tool.base(words, np.zeros(len(words), np.int64))
    sym, of = tool._rounds(words, base)
    for i, w in enumerate(words):
        assert sym[of == i].tolist() == tool._agenda(w, int(base[i])).tolist()


M64 = (1 << 64) - 1


def splitmix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def plain_dropout(sp, word, variant, rate, seed):
    """Merge-dropout from its definition: of all adjacent pairs whose concatenation is a piece and whose span is not
    skipped, the one of the best score, the leftmost of equals, until there is none."""
    pieces = {sp.id_to_piece(i).replace("\u2581", " "): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    key = splitmix((xxhash.xxh64_intdigest(word.encode(), seed) + variant * 0x9E3779B97F4A7C15) & M64)
    skipped = lambda a, b: splitmix(key ^ splitmix(a << 32 | b)) < int(rate * (2**64 - 2048))
    parts = [(c, i, i + 1) for i, c in enumerate(word)]
    while True:
        found = []
        for k in range(len(parts) - 1):
            (x, a, _), (y, _, b) = parts[k : k + 2]
            if x in pieces and y in pieces and x + y in pieces and not skipped(a, b):
                found.append((-sp.get_score(pieces[x + y]), k))
        if not found:
            break
        _, k = min(found)
        parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], parts[k][1], parts[k + 1][2])]
    out = []
    for x, _, _ in parts:
        out += [pieces[x]] if x in pieces else [sp.piece_to_id(f"<0x{b:02X}>") for b in x.encode()]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_dropout_equals_its_definition(vocabulary, rate):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=bpe_dropout.MODEL)
    tool = bpe_dropout.Segmenter(vocabulary, rate, seed=20)
    rng = random.Random(6)
    words = [" international", " the", "   deep", " é日x", " " + "ab" * 40, " x"] + [" " + "".join(rng.choices("abcdeinorstué", k=rng.randint(1, 14))) for _ in range(40)]
    for variant in range(4):
        got, count = tool.segment(words, np.full(len(words), variant))
        for w, own in zip(words, np.split(got, np.cumsum(count)[:-1])):
            assert own.tolist() == plain_dropout(sp, w, variant, rate, 20)


def test_all_dropped_leaves_characters(vocabulary):
    tool = bpe_dropout.Segmenter(vocabulary, 1.0)
    assert len(tool.encode(["hello"], [0])[0]) == 6


def test_tokens_of_tables(docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (None, "null id"), (3, TEXTS[3])]
    got = bpe_dropout.tokenise(docs_of(rows)).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert {r.n_pieces for r in got if r.doc_id == 90} == {0}
    back = bpe_dropout.detokenise(bpe_dropout.tokenise(docs_of(rows))).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i if i is not None else -1, t or "") if i else (-1, t or "") for i, t in rows)
    assert bpe_dropout.tokenise(docs_of([])).count() == 0


# ---- language model --------------------------------------------------------------------------------------------------


def tokens(t):
    return (t or "").encode().lower().split() + [None]


def corpus():
    rng = random.Random(8)
    words = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    return [(i, " ".join(rng.choices(words[i % 2], k=rng.randint(0, 60)))) for i in range(300)] + [(300, None), (301, "Unseen WORDS"), (4, "a1 a2 a3"), (None, "a1")]


def test_base_scores_and_gain(docs_of):
    rows = corpus()
    got = hpylm.score(docs_of(rows), burn_in=1, samples=2).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((i or -1, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    own = [r for r in got if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_wide_chunks_are_sorted_another_way(docs_of, monkeypatch):
    rows = corpus()
    want = sorted((r.doc_id or -1, r.n_tokens, r.score) for r in hpylm.score(docs_of(rows), burn_in=1, samples=1).collect())
    monkeypatch.setattr(hpylm, "WIDE", 0)
    assert sorted((r.doc_id or -1, r.n_tokens, r.score) for r in hpylm.score(docs_of(rows), burn_in=1, samples=1).collect()) == want


def test_very_long_texts(docs_of):
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    got = {r.doc_id: r for r in hpylm.score(docs_of([(1, long), (2, "w1 w2"), (3, "x" * 500_000)]), burn_in=1, samples=1).collect()}
    assert got[1].n_tokens == 300_001 and all(math.isfinite(r.score) for r in got.values())


def test_language_model_without_text(docs_of):
    assert hpylm.score(docs_of([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = hpylm.score(docs_of([(held, "only held out")])).collect()
    assert (r.train_tokens, r.n_tokens, r.n_known) == (0, 4, 0) and math.isfinite(r.score)


def test_table_draws_follow_their_distribution():
    d, a, p, others, c = 0.6, 1.0, 0.05, 3, 4
    table = np.exp(hpylm._stirling(d)[c, 1 : c + 1])
    weight = np.array([np.prod([a + d * (others + j) for j in range(t)]) * p**t * table[t - 1] for t in range(1, c + 1)])
    n = 200_000
    got = hpylm.draw_tables(np.full(n, c), np.full(n, others), np.full(n, p), d, a, np.random.default_rng(1))
    assert np.allclose(np.bincount(got, minlength=c + 1)[1:] / n, weight / weight.sum(), atol=0.005)


def test_long_tables_stay_in_range():
    c = np.array([0, 1, 2, 47, 48, 49, 1000, 10**6])
    t = hpylm.draw_tables(c, np.zeros(8), np.full(8, 0.01), 0.7, 1.0, np.random.default_rng(3))
    assert t[0] == 0 and (t[1:] >= 1).all() and (t <= c).all()


@pytest.mark.parametrize("d", [0.1, 0.5, 0.8, 0.95])
def test_stirling_numbers_by_integral(d):
    table = hpylm._stirling(d, 900)
    for c in (257, 900):
        t = np.arange(1, c + 1)
        assert np.abs(hpylm.log_stirling(np.full(c, c), t, d) - table[c, 1 : c + 1]).max() < 2e-3


@pytest.mark.parametrize("c,others,p,d,a", [(48, 100, 0.02, 0.7, 1.0), (256, 20, 0.1, 0.7, 1.0), (300, 2000, 0.0005, 0.6, 1.0), (300, 4000, 0.05, 0.8, 2.0), (300, 5, 0.001, 0.7, 1.0), (700, 900, 0.5, 0.5, 0.3), (300, 10**6, 0.9, 0.8, 1.0)])
def test_large_dishes_are_drawn_from_their_weights(c, others, p, d, a):
    """Both ways to draw agree with the weights from the recurrence, on both sides of the switch."""
    t = np.arange(1, c + 1)
    log = hpylm._stirling(d, c)[c, 1:] + np.cumsum(np.log(a + d * (others + t - 1)) + math.log(p))
    weight = np.exp(log - log.max())
    weight /= weight.sum()
    mean, n = float((weight * t).sum()), 4000
    deviation = math.sqrt(float((weight * (t - mean) ** 2).sum()))
    rng = np.random.default_rng(2)
    draws = [hpylm._draw_large(np.full(n, float(c)), np.full(n, float(others)), np.full(n, p), d, a, rng)]
    if c <= hpylm.STIRLING:
        draws.append(hpylm.draw_tables(np.full(n, c), np.full(n, others), np.full(n, p), d, a, rng))
    for got in draws:
        assert abs(got.mean() - mean) < 5 * deviation / math.sqrt(n) + 1e-9
        assert abs(got.std() - deviation) < 0.06 * deviation + 1e-9
        assert got.min() >= 1 and got.max() <= c


def test_very_large_dishes():
    """For ever more customers, t - 1 is negative binomial; the mean of that is known."""
    n, d, a, others, p = 2000, 0.7, 1.0, 100, 0.02
    got = hpylm._draw_large(np.full(n, 1e9), np.full(n, float(others)), np.full(n, p), d, a, np.random.default_rng(4))
    want = 1 + ((a + d * others) / d + 1) * p / (1 - p)
    assert abs(got.mean() - want) < 0.15
    for c, others in ((1e9, 25_000.0), (1e12, 1e6)):
        got = hpylm._draw_large(np.full(n, c), np.full(n, others), np.full(n, p), d, a, np.random.default_rng(4))
        want = 1 + ((a + d * others) / d + 1) * p / (1 - p)
        assert abs(got.mean() / want - 1) < 0.02
    many = hpylm._draw_large(np.array([1e7, 5e6]), np.array([1e6, 1e6]), np.array([0.05, 0.3]), 0.8, 1.0, np.random.default_rng(5))
    assert (many > 1000).all() and (many < 5e6).all()


def sequential(counts, words, sweeps, burn, d, d0, a, a0, rng):
    """Gibbs sampling of all tables one after the other. Mean tables and mean predictive probability of every (u, w)."""
    vocabulary = len(words)
    t, t0, base = {k: 1 for k in counts}, {}, 1 / (vocabulary + 1)
    c0 = Counter(w for _, w in t)
    t0 = {w: 1 for w in c0}
    t_u, c_u = Counter(u for u, _ in t), Counter()
    for (u, _), c in counts.items():
        c_u[u] += c
    total, seen, prob = 0.0, 0, Counter()
    parent = lambda w: (c0[w] - d0 * t0[w] + (a0 + d0 * sum(t0.values())) * base) / (a0 + sum(c0.values()))
    one = lambda c, others, p, dd, aa: int(hpylm.draw_tables(np.array([c]), np.array([others]), np.array([p]), dd, aa, rng)[0])
    for sweep in range(sweeps):
        for (u, w), c in counts.items():
            new = one(c, t_u[u] - t[u, w], parent(w), d, a)
            t_u[u] += new - t[u, w]
            c0[w] += new - t[u, w]
            t[u, w] = new
        for w in t0:
            t0[w] = one(c0[w], sum(t0.values()) - t0[w], base, d0, a0)
        if sweep >= burn:
            total, seen = total + sum(t.values()), seen + 1
            for (u, w), c in counts.items():
                prob[u, w] += (c - d * t[u, w] + (a + d * t_u[u]) * parent(w)) / (a + c_u[u])
    return total / seen, {k: v / seen for k, v in prob.items()}


def test_scores_agree_with_a_sequential_sampler(docs_of):
    """Parallel sweeps over tables of Spark against one dish after the other, on a small corpus, strengths held."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(25)], k=40))) for i in range(120)]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    counts = Counter()
    for text in train:
        w = tokens(text)
        counts.update(zip(["^", *w[:-1]], w))
    ones, twos = (sum(1 for c in counts.values() if c == k) for k in (1, 2))
    got = hpylm.score(docs_of(rows), burn_in=0, samples=12).collect()
    d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
    _, prob = sequential(counts, words + [None], 30, 8, d, 0.1, 1.0, 1.0, np.random.default_rng(6))
    own = {r.doc_id: r.score for r in got}
    texts = [(i, tokens(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    want = {i: sum(math.log10(prob[k]) for k in zip(["^", *w[:-1]], w)) for i, w in texts}
    assert max(abs(own[i] - want[i]) / abs(want[i]) for i in want) < 0.02


def test_perplexity(spark):
    rows = spark.createDataFrame([(True, -3.0, 2), (True, -1.0, 2), (False, -4.0, 1)], "held_out boolean, score double, n_tokens long")
    got = {r.held_out: (r.perplexity, r.n_tokens) for r in hpylm.perplexity(rows).collect()}
    assert got == {True: (pytest.approx(10.0), 4), False: (pytest.approx(10_000.0), 1)}
    assert hpylm.perplexity(rows.limit(0)).count() == 0


def test_strength_terms_equal_their_means():
    rng = np.random.default_rng(7)
    customers, tables, d, a = np.array([1, 10, 500, 4]), np.array([1, 6, 90, 1]), 0.6, 2.0
    got = np.array([hpylm.strength_terms(customers, tables, d, a, rng) for _ in range(3000)])
    opened = sum(a / (a + d * i) for t in tables for i in range(1, t))
    waits = sum(sum(1 / (a + 1 + k) for k in range(c - 1)) for c in customers if c > 1)
    assert abs(got[:, 0].mean() - opened) < 0.15 and abs(got[:, 1].mean() - waits) < 0.15


def test_predictive_probabilities_sum_to_one():
    m = {"d0": 0.5, "a0": 1.0, "base": 1 / 4}
    c0, t0 = np.array([5, 2, 1, 0]), np.array([2, 1, 1, 0])
    m |= {"C0": 8.0, "T0": 4.0}
    assert math.isclose(hpylm._parent(c0, t0, m).sum(), 1.0)


# ---- preferences -----------------------------------------------------------------------------------------------------


def marked(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=30))) for i in range(0, 200, 2)]
    bad = [(i, " ".join(w + "###" for w in rng.choices(["alpha", "beta", "gamma", "delta"], k=30))) for i in range(1, 201, 2)]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(0, None, None), (None, 1, 0), (2, 0, 0)]
    return good + bad, spark.createDataFrame(labels, "doc_id long, quality int, score int")


def test_quality_on_held_out_labels(spark, docs_of):
    rows, labels = marked(spark)
    got = bradley_terry.classify(docs_of(rows + [(900, None), (901, ""), (None, "alpha"), (3, rows[-1][1])]), labels).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None and r.doc_id < 900:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    wrong = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900 and r.predicted != (r.doc_id + 1) % 2]
    assert len(wrong) <= 1


def test_fit_minimises_the_pairwise_loss():
    """The loss over the drawn pairs, written out, does not fall in any direction from the fitted weights."""
    rng = np.random.default_rng(3)
    width = bradley_terry.features("").size
    good, bad = rng.normal(0.3, 1, (60, width)), rng.normal(0, 1, (40, width))
    model = bradley_terry.fit(good, bad, 0.3, pairs=4000)
    draw = np.random.default_rng(7)
    a, b = draw.integers(0, 60, 4000), draw.integers(0, 40, 4000)
    scale = np.concatenate([good, bad]).std(0)
    w = model["w"] * scale

    def loss(w):
        total = 0.0
        for i, j in zip(a, b):
            total += math.log1p(math.exp(-float(((good[i] - bad[j]) / scale) @ w)))
        return total / len(a) + 0.5e-3 * float(w @ w)

    least = loss(w)
    for k in range(width):
        for step in (1e-2, -1e-2):
            other = w.copy()
            other[k] += step
            assert loss(other) > least
    strength = np.concatenate([good, bad]) @ model["w"] - model["mean"] @ model["w"]
    assert abs((strength >= model["at"]).mean() - 0.6) < 0.02


def test_a_sampled_id_counts_once(spark, docs_of):
    rows, labels = marked(spark)
    many = docs_of(rows + [rows[0]] * 50)
    one, again = bradley_terry.labelled_features(docs_of(rows), labels, labels.doc_id >= 0), bradley_terry.labelled_features(many, labels, labels.doc_id >= 0)
    assert all(np.array_equal(x, y) for x, y in zip(one, again))


def test_quality_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in bradley_terry.classify(docs_of([(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert bradley_terry.classify(docs_of([]), none).count() == 0


def test_quality_features_are_finite():
    for t in ("", " ", "\n\n", "x" * 100_000, "é" * 10, "! ! !", "a a a a"):
        assert np.isfinite(bradley_terry.features(t)).all()


@pytest.fixture
def feature_rows(spark):
    """A table of random feature rows of both classes, and the rows."""
    rng = np.random.default_rng(5)
    width = bradley_terry.features("").size
    good, bad = rng.normal(0.3, 1, (300, width)), rng.normal(0, 1.5, (150, width))
    good[:, 3] = bad[:, 3] = 0.3  # says nothing
    rows = [(i, 1, x.tobytes()) for i, x in enumerate(good)] + [(1000 + i, 0, x.tobytes()) for i, x in enumerate(bad)]
    return spark.createDataFrame(rows, "doc_id long, quality int, f binary").repartition(3), good, bad


def test_all_pairs_of_all_rows_are_fitted(feature_rows):
    """The slope of the loss over all pairs, written out, is nothing at the fitted weights."""
    table, good, bad = feature_rows
    model = bradley_terry.fit_table(table, 0.3)
    every = np.concatenate([good, bad])
    scale = every.std(0)
    scale[scale < 1e-9] = np.inf
    w = np.where(np.isinf(scale), 0, model["w"] * np.where(np.isinf(scale), 0, scale))
    x = ((good[:, None] - bad[None, :]) / scale).reshape(-1, len(w))
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - 1) / len(x) + 1e-3 * w).max() < 1e-4 and np.abs(w).max() > 0.1
    strength = (every - model["mean"]) @ model["w"]
    assert model["at"] == pytest.approx(np.quantile(strength, 150 / 450), abs=1e-9)


def test_order_statistics_are_exact(feature_rows):
    table, good, bad = feature_rows
    every = np.concatenate([good, bad])
    for strength in (lambda f: f[:, 0] * 1e6, lambda f: np.round(f[:, 0]), lambda f: f[:, 3]):
        for few in (1, 100):
            ranks = [0, 1, 200, 201, 448, 449]
            assert bradley_terry._order_statistics(table, strength, ranks, few) == np.sort(strength(every))[ranks].tolist()


def test_every_label_counts(spark, docs_of):
    """More labelled documents than the 20,000 that were fitted once."""
    n = 20_500
    docs = docs_of([(i, f"a{i % 7}") for i in range(n)])
    labels = spark.range(n).select("id", "id").toDF("doc_id", "x").selectExpr("doc_id", "cast(x % 2 as int) quality")
    good, bad = bradley_terry.labelled_features(docs, labels, labels.doc_id >= 0)
    assert len(good) + len(bad) == n
