import hashlib
import random

import numpy as np
import pytest
import xxhash

from kinlink.llm import simhash_trie, suffix_dedup

WORDS = [f"w{i}" for i in range(300)]


def texts(seed=3):
    rng = random.Random(seed)
    out = [" ".join(rng.choices(WORDS, k=rng.randint(1, 200))) for _ in range(60)]
    for t in out[:25]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out + [out[0], out[0], "", "   ", "One  Two", "one two", "é É", " ".join(WORDS * 40)]


def brute_fingerprint(text):
    words = text.encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_simhash_equals_brute_force(docs_of):
    rows = list(enumerate(texts()))
    prints = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(prints)
    got = {r.doc_id: r for r in simhash_trie.near_duplicates(docs_of(rows)).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want


def test_simhash_null_repeated_and_empty(docs_of):
    got = simhash_trie.near_duplicates(docs_of([(5, None), (3, ""), (9, "a b"), (9, "a b"), (None, "a b")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 9), (3, 3), (5, 3), (9, 9), (9, 9)]
    (lone,) = simhash_trie.near_duplicates(docs_of([(None, "c d")])).collect()
    assert (lone.doc_id, lone.component_id) == (None, None) and int(lone.fingerprint, 16) == brute_fingerprint("c d")
    assert simhash_trie.near_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("block", [1 << 21, 7])
def test_trie_finds_every_link(monkeypatch, block):
    monkeypatch.setattr(simhash_trie, "PAIR_BLOCK", block)
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [s ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for s in seeds[:20] for a, b in rng.integers(0, 43, (3, 2))]
    keys = np.unique(np.r_[seeds, np.array(near, np.uint64)])
    i, j = simhash_trie.trie_links(keys, 21, 2)
    root = np.arange(len(keys))
    root[i] = j
    for a in range(len(keys)):
        for b in range(len(keys)):
            if keys[a] >> np.uint64(43) == keys[b] >> np.uint64(43) and int(keys[a] ^ keys[b]).bit_count() <= 2:
                assert root[a] == root[b]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "fp long, root long")
    got = {r.node: r.root for r in simhash_trie.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def brute_removal(rows, length=50):
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, x in raw:
        for k in range(len(x) - length + 1):
            s = x[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, x in raw:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if first[x[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def repeated(seed=4):
    rng = random.Random(seed)
    passage = " ".join(rng.choices(WORDS, k=70))
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 60)))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " é " + passage + rows[i + 1][1]) for i in range(10)]
    return rows + [(7, rows[7][1]), (200, "ab" * 400), (201, "b" + "ab" * 300), (202, "x" * 49), (203, "x" * 50), (204, "x" * 120), (205, None), (206, "")]


@pytest.mark.parametrize("hot,cut", [(20_000, 1 << 20), (2, 1 << 20), (20_000, 300)])
def test_removal_equals_brute_force(docs_of, monkeypatch, hot, cut):
    monkeypatch.setattr(suffix_dedup, "SLICE", cut)
    monkeypatch.setattr(suffix_dedup, "SORT", 5_000)
    rows = repeated()
    got = suffix_dedup.deduplicate(docs_of(rows + [(None, "x" * 80)]), hot=hot).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None) == brute_removal(rows)
    assert [(r.n_bytes, r.n_removed, r.kept) for r in got if r.doc_id is None] == [(80, 0, b"x" * 80)]
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_removal_of_nothing(docs_of):
    assert suffix_dedup.deduplicate(docs_of([])).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 8, 60, 400):
        for k in (2, 4, 300):
            t = rng.integers(1, k, n)
            assert suffix_dedup.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def jaccard(a, b, width=5):
    x, y = set(simhash_trie.shingles(a, width)), set(simhash_trie.shingles(b, width))
    return len(x & y) / max(1, len(x | y))


@pytest.mark.parametrize("small", [64, 2])
def test_similar_documents_are_found_and_others_kept(docs_of, monkeypatch, small):
    monkeypatch.setattr(simhash_trie, "SMALL", small)
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(60):
        words = rng.choices(WORDS, k=rng.randint(60, 300))
        rows.append((i, " ".join(words)))
        for k in range(rng.randint(0, 3)):
            other = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 80))):
                other[rng.randrange(len(other))] = f"x{rng.random()}"
            if jaccard(rows[i][1], " ".join(other)) >= 0.85:
                want[1000 + 10 * i + k] = i
                rows.append((1000 + 10 * i + k, " ".join(other)))
    rows.sort()
    kept = {r.doc_id for r in simhash_trie.representatives(docs_of(rows + [(None, rows[0][1]), (5000, ""), (5001, None)])).collect()}
    assert kept == set(range(60)) | {None, 5000}


def test_leaf_links_equal_brute_force():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 2**63, (30, simhash_trie.WORDS), dtype=np.uint64)
    words[10:20] = words[:10] ^ np.uint64(7)
    leaf, own, member = np.zeros(30, np.int64), np.ones(30, bool), np.arange(30)
    for small in (64, 2):
        simhash_trie.SMALL, before = small, simhash_trie.SMALL
        label = simhash_trie.leaf_links(leaf, own, member, words, 20)
        simhash_trie.SMALL = before
        assert label.tolist() == [*range(10), *range(10), *range(20, 30)]


def exact_kept(rows, similarity=0.8):
    """Smallest ids of the components of all pairs whose Jaccard similarity reaches the threshold."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if i < j and jaccard(a, b) >= similarity:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


@pytest.mark.parametrize("small,closest", [(64, 8), (2, 1)])
def test_only_exact_similarity_links(docs_of, monkeypatch, small, closest):
    monkeypatch.setattr(simhash_trie, "SMALL", small)
    monkeypatch.setattr(simhash_trie, "CLOSEST", closest)
    rows, near = [], 0
    for k, (n, cut) in enumerate([(96, 16), (96, 17), (96, 18), (96, 20), (96, 24), (14, 2), (14, 3), (104, 20), (104, 21), (404, 80), (404, 81), (404, 90)]):
        words = [f"k{k}w{i}" for i in range(n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[cut:]))]
        near += 0.65 < jaccard(rows[-2][1], rows[-1][1]) < 0.8
    # variants of one text, each close to it and not to each other; the text itself has the largest id
    base = [f"b{i}" for i in range(204)]
    for v in range(8):
        rows.append((100 + v, " ".join("x%d" % v if i in (20 * v + 5, 20 * v + 11, 20 * v + 17) else w for i, w in enumerate(base))))
    rows.append((200, " ".join(base)))
    want = exact_kept(rows)
    assert near >= 5 and len(want) < len(rows) - 5
    assert {r.doc_id for r in simhash_trie.representatives(docs_of(rows)).collect()} == want


def test_set_links_equal_brute_force():
    rng = np.random.default_rng(8)
    sets = []
    for g in range(12):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        for _ in range(9):
            own = base.copy()
            own[rng.integers(0, 60, rng.integers(0, 14))] = rng.integers(0, 2**63, 1, dtype=np.uint64)
            sets.append(np.unique(own[: rng.integers(40, 61)]))
    sets += [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    rng.shuffle(sets)
    for first in (None, 50):
        for closest in (1, 8, 500):
            simhash_trie.CLOSEST, before = closest, simhash_trie.CLOSEST
            got = simhash_trie.set_links(sets, 0.8, first).tolist()
            simhash_trie.CLOSEST = before
            want = list(range(len(sets)))
            for i, x in enumerate(sets):
                for j, y in enumerate(sets):
                    both = len(np.intersect1d(x, y))
                    if (i < j if first is None else i < first <= j) and both >= 0.8 * max(1, len(x) + len(y) - both):
                        low, high = sorted((want[i], want[j]))
                        want = [low if w == high else w for w in want]
            assert got == want


@pytest.mark.parametrize("cell", [1 << 21, 2000])
def test_a_group_below_the_threshold_is_not_paired(docs_of, monkeypatch, cell):
    """All 90 texts are alike at about 0.7, so all pairs are candidates; some have a copy at 0.9. Rows do not grow with the pairs."""
    monkeypatch.setattr(simhash_trie, "CELL", cell)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(204)]
    rows = []
    for v in range(90):
        words = list(base)
        for j in range(4):
            words[10 + 50 * j + rng.randrange(30)] = f"x{v}y{j}"
        rows.append((v, " ".join(words)))
        if v % 9 == 0:
            rows.append((1000 + v, " ".join(words[:-1] + ["end"])))
    made, write = [], simhash_trie.materialise

    def counted(df, tag, path=None):
        out = write(df, tag, path)
        made.append((out.count(), tag))
        return out

    monkeypatch.setattr(simhash_trie, "materialise", counted)
    assert {r.doc_id for r in simhash_trie.representatives(docs_of(rows)).collect()} == exact_kept(rows)
    assert max(made)[0] <= 2 * len(rows), made
