"""SimHash near-duplicates through a binary-trie self-join.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Distinct fingerprints are
joined with themselves on a binary trie: pairs of nodes are walked together level by level, differing bits add up and a
pair is dropped as soon as they exceed the budget. The walk is distributed with the fingerprint cut into budget + 1
blocks: fingerprints at most `bits` apart share at least one block, so for each block the trie is rooted there (the
block's bits on top) and every node at that depth is an independent walk from the pair (node, node).

A group of copies becomes one fingerprint before the join, and a walk hands out a spanning star per connected piece,
never its pairs. Components come from alternating star contraction on tables in the shared folder.

Defined results: null or blank text has fingerprint zero and links like any other; rows with a null doc_id are linked like
others but name no component (a component of such rows alone has none); a repeated doc_id with several texts is in the
component of all of them only by its own rows; repeated rows are repeated; an empty table gives an empty result; extra
columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import materialise, salted_lookup, sliced, tasks_for, text_table, trim

#: Shingle hashes are counted in blocks of this many, node pairs walked in blocks of that many: bounds on memory.
HASH_BLOCK, PAIR_BLOCK = 1 << 14, 1 << 21
#: Distinct fingerprints of a task of walks.
PRINTS = 20_000


def shingles(text: str, width: int = 3) -> list[bytes]:
    """Space-joined word shingles with repeats; fewer words give the whole sequence, none gives none."""
    words = text.encode("utf-8").lower().split()  # on bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    parts, digest = shingles(text, width), xxhash.xxh64_intdigest
    if not parts:
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(parts), HASH_BLOCK):
        h = np.fromiter((digest(x, seed) for x in parts[k : k + HASH_BLOCK]), ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, width, seed) for x in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return text_table(docs).mapInArrow(run, "doc_id long, fp long")


def _blocks(bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of bits + 1 blocks."""
    cuts = [64 * i // (bits + 1) for i in range(bits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _turned(fp: np.ndarray, first: int) -> np.ndarray:
    """fp rotated so that its bit `first` from the top leads."""
    return fp if first == 0 else (fp << np.uint64(first)) | (fp >> np.uint64(64 - first))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of n through edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def trie_links(keys: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Walks the trie over sorted distinct 64-bit keys from every node at `depth` with itself.

    Returns (index, index of the smallest key of its connected piece) for all keys that are linked to a smaller one.
    Node pairs are ranges of the sorted keys; where the pairs at hand outgrow a block, they are walked in halves."""
    n = len(keys)
    top = keys >> np.uint64(64 - depth)
    start = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if n else np.zeros(0, np.int64)
    end = np.r_[start[1:], n].astype(np.int64)
    keep = end - start > 1
    start, end = start[keep].astype(np.int64), end[keep]
    label = np.arange(n)
    work = [(depth, start, end, start, end, np.zeros(len(start), np.int8))]
    while work:
        at, a0, a1, b0, b1, err = work.pop()
        if not len(a0):
            continue
        if at == 64:
            label = _merged(label, a0, b0)
            continue
        if len(a0) > PAIR_BLOCK:
            half = len(a0) // 2
            work += [(at, *(x[half:] for x in (a0, a1, b0, b1, err))), (at, *(x[:half] for x in (a0, a1, b0, b1, err)))]
            continue
        bit = _ones(keys, at)
        am, bm = a1 - (bit[a1] - bit[a0]), b1 - (bit[b1] - bit[b0])
        same, more = a0 == b0, err < bits
        apart = ~same & more
        cut = [
            (a0, am, b0, bm, err, None),
            (am, a1, bm, b1, err, None),
            (a0, am, bm, b1, err + 1, more),
            (am, a1, b0, bm, err + 1, apart),
        ]
        parts = []
        for x0, x1, y0, y1, e, where in cut:
            ok = (x1 > x0) & (y1 > y0) & ~((x0 == y0) & (x1 - x0 < 2))
            if where is not None:
                ok &= where
            parts.append([x[ok] for x in (x0, x1, y0, y1, e)])
        work.append((at + 1, *(np.concatenate(x) for x in zip(*parts))))
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


_CACHE: dict = {}


def _ones(keys: np.ndarray, at: int) -> np.ndarray:
    """Running count of ones in bit `at` from the top."""
    if _CACHE.get("keys") is not keys:
        _CACHE.clear()
        _CACHE["keys"] = keys
    if at not in _CACHE:
        for old in [x for x in _CACHE if x != "keys" and len(_CACHE) > 8]:
            del _CACHE[old]
        _CACHE[at] = np.r_[0, np.cumsum(((keys >> np.uint64(63 - at)) & np.uint64(1)).astype(np.int64))]
    return _CACHE[at]


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    used, at = np.unique(np.concatenate([label[a], label[b]]), return_inverse=True)
    to = label.copy()
    to[used] = used[_roots(len(used), at[: len(a)], at[len(a) :])]
    return to[label]


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """fp, root: a spanning star for each connected piece within each block's walks. distinct: column fp, no repeats."""
    blocks, n = _blocks(bits), max(1, distinct.count() // PRINTS)
    keyed = []
    for k, (first, width) in enumerate(blocks):
        value = F.shiftrightunsigned(F.col("fp"), 64 - first - width).bitwiseAND(F.lit((1 << width) - 1))
        keyed.append(F.struct(F.lit(k).alias("block"), F.pmod(F.xxhash64(F.lit(k), value), F.lit(n)).cast("int").alias("shard")))
    spread = distinct.select("fp", F.explode(F.array(*keyed)).alias("x")).select("fp", "x.block", "x.shard")

    def run(key, table):
        block = table.column("block").to_numpy()
        fps = table.column("fp").to_numpy().view(np.uint64)
        out: list[np.ndarray] = []
        for k, (first, width) in enumerate(blocks):
            own = fps[block == k]
            keys = np.sort(_turned(own, first))
            i, j = trie_links(keys, width, bits)
            back = _turned(keys, (64 - first) % 64)
            out.append(np.stack([back[i], back[j]]))
        both = np.concatenate(out, axis=1).view(np.int64)
        return pa.table({"fp": both[0], "root": both[1]})

    return spread.groupBy("shard").applyInArrow(run, "fp long, root long")


def components(edges: DataFrame, a: str = "fp", b: str = "root") -> DataFrame:
    """Alternating large-star and small-star contraction; node, root for every node of an edge. Each round is a
    written table, and only minima of a node's neighbours are gathered, never their lists; a node with very many
    neighbours is spread over tasks when its minimum is looked up."""
    pairs = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    mark = lambda df: tuple(df.agg(F.count("*"), *[F.expr(f"bit_xor(xxhash64({k}, u, v))") for k in (1, 2)]).first())
    seen = mark(pairs)
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_lookup(both, low, "u", "v", how="inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_lookup(large, least, "u", "v", how="inner").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        now = mark(new)
        if now == seen:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        pairs, seen = new, now


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links of at most `bits`)."""
    prints = materialise(fingerprints(docs, width, seed), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), bits))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    found = salted_lookup(prints, label, "fp", "doc_id", how="inner")  # null ids of one fingerprint share a salt
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- similarity instead of a few bits ---------------------------------------------------------------------------------
#
# At a Jaccard similarity of 0.8 about 15 % of a fingerprint's bits differ, far more than a trie walk can spare without
# meeting nearly every pair of nodes. The bits that differ are those whose majority was narrow, so the walk is allowed to
# take both children at a node whose bit is narrow: each 16-bit block of the first words is a trie of its own, a
# document is put at its own leaf and at those that differ in its PROBES narrowest bits, and pairs that meet at a leaf go on
# word by word over all 256 bits, adding up differing bits and leaving as soon as they exceed the budget.
#
# Such pairs are candidates only, and a leaf hands out a spanning star of them. What they connect is a blob: all candidate
# pairs lie inside one. The texts of a blob meet once in one task, as the hashes of their shingles, and every pair there is
# compared exactly: common shingles are counted by posting lists, those of many texts by matrix products, and no pair is a
# row. An edge is kept if the Jaccard similarity of the two shingle sets reaches the threshold, so a large group of similar
# texts costs its square in products, never in rows or disk. A blob of over CELL shingles is dealt over cells, and each
# pair of cells is a task. Documents of equal shingle sets are one node.

WORDS, BLOCK_BITS, BLOCKS, PROBES = 4, 16, 8, 4
#: Deviations over the mean that a candidate pair may differ by; texts up to which all pairs are counted by posting lists.
SPARE, CLOSEST = 4.0, 8
#: Ids of documents with a candidate that are sent to all tasks; shingles of a blob's cell, and of the blobs of one task.
BROADCAST_IDS, CELL = 1_000_000, 1 << 21
#: Bytes of text whose leaves are walked in one task.
SHARD_BYTES = 16 << 20
#: Groups up to this many members are compared as one array, larger ones member by member.
SMALL = 64


def _hashes(text: str, width: int, seed: int) -> np.ndarray:
    """The shingle set, as sorted hashes."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, seed) for x in shingles(text, width)), np.uint64))


def _wide(text: str, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, bytes, int]:
    """256 majority bits of the shingle set as words, for each block the bits of its leaf with the narrowest
    majorities, the digest of the set and its size."""
    parts = _hashes(text, width, seed)
    margin = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(parts), HASH_BLOCK):
        h = parts[k : k + HASH_BLOCK]
        for i in range(WORDS):
            own = h if not i else _remixed(h, i)
            bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            margin[64 * i : 64 * i + 64] += 2 * bits.sum(0, dtype=np.int64)
    margin -= len(parts)
    words = np.frombuffer(np.packbits(margin > 0).tobytes(), ">u8").astype(np.uint64)
    narrow = np.argsort(np.abs(margin[: BLOCK_BITS * BLOCKS]).reshape(BLOCKS, BLOCK_BITS), axis=1, kind="stable")[:, :PROBES]
    return words, np.left_shift(1, BLOCK_BITS - 1 - narrow).astype(np.int64), hashlib.blake2b(parts.tobytes(), digest_size=16).digest(), len(parts)


def _remixed(h: np.ndarray, i: int) -> np.ndarray:
    x = h + np.uint64(0x9E3779B97F4A7C15 * i % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def budget_of(similarity: float, spare: float = 2.0) -> int:
    """Differing bits of 256 that a pair of this Jaccard similarity stays within, `spare` deviations over the mean."""
    angle = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(64 * WORDS * angle + spare * np.sqrt(64 * WORDS * angle * (1 - angle)))


_LEAF_SQL = "shard int, ids binary, words binary, member binary, leaf binary"


def _wide_step(width: int, seed: int):
    """doc_id, words, narrow, digest, shingles of every document."""

    def run(batches):
        for b in sliced(batches):
            found = [_wide(x, width, seed) for x in b.column("text").to_pylist()]
            own = [pa.array([bytes(x[i]) for x in found], pa.binary()) for i in range(3)]
            yield pa.record_batch([b.column("doc_id"), *own, pa.array([x[3] for x in found], pa.int64())], names=["doc_id", "words", "narrow", "digest", "shingles"])
        trim()

    return run


def _leaf_step(n: int):
    """To each shard of leaves: the fingerprints that are put there."""

    def run(batches):
        flips = np.arange(1 << PROBES)
        for b in sliced(batches, 4096):
            ids = b.column("doc_id").to_numpy()
            if not len(ids):
                continue
            words = np.frombuffer(b"".join(b.column("words").to_pylist()), np.uint64).reshape(-1, WORDS)
            narrow = np.frombuffer(b"".join(b.column("narrow").to_pylist()), np.int64).reshape(-1, BLOCKS, PROBES)
            block = np.stack([(words[:, k // 4] >> np.uint64(48 - 16 * (k % 4))).astype(np.int64) & 0xFFFF for k in range(BLOCKS)], axis=1)
            change = np.zeros((len(ids), BLOCKS, len(flips)), np.int64)
            for j in range(PROBES):
                change += narrow[:, :, j, None] * (flips >> j & 1)
            leaf = (np.arange(BLOCKS)[None, :, None] << BLOCK_BITS) + (block[:, :, None] ^ change)
            own = np.broadcast_to(flips == 0, leaf.shape)
            member = np.broadcast_to(np.arange(len(ids))[:, None, None], leaf.shape)
            leaf, own, member = (x.reshape(-1) for x in (leaf, own, member))
            shard = ((leaf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(n + 1))
            rows = []
            for s in range(n):
                at = order[cut[s] : cut[s + 1]]
                if len(at):
                    used, place = np.unique(member[at], return_inverse=True)
                    rows.append((s, ids[used].tobytes(), words[used].tobytes(), place.astype(np.uint32).tobytes(), (leaf[at] * 2 + own[at]).astype(np.uint32).tobytes()))
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["shard", "ids", "words", "member", "leaf"])
            del rows, leaf, own, member, shard, order, block, change
        trim()

    return run


def _apart(a: np.ndarray, b: np.ndarray, budget: int) -> np.ndarray:
    """Pairs of rows within the budget, word by word."""
    alive, error = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i in range(WORDS):
        error = error + np.bitwise_count(a[alive, i] ^ b[alive, i])
        keep = error <= budget
        alive, error = alive[keep], error[keep]
    return alive


def _blocks_of(at: np.ndarray, count: np.ndarray):
    """Groups in turn, as many together as make about PAIR_BLOCK / 4 pairs."""
    ends = np.cumsum(count[at])
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIR_BLOCK // 4, "right")))
        yield at[i:j]
        i = j


def leaf_links(leaf: np.ndarray, own: np.ndarray, member: np.ndarray, words: np.ndarray, budget: int) -> np.ndarray:
    """Smallest member index connected to each member over links found at the leaves. A pair is compared where one of
    the two is at its own leaf."""
    order = np.lexsort((~own, leaf))
    leaf, own, member = leaf[order], own[order], member[order]
    start = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]) if len(leaf) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(leaf)])
    homes = np.add.reduceat(own.astype(np.int64), start) if len(leaf) else size
    label = np.arange(len(words))
    small = (size <= SMALL) & (size > 1) & (homes > 0)
    for at in _blocks_of(np.flatnonzero(small), homes * size):
        count = homes[at] * size[at]
        base, total = np.repeat(start[at], count), int(count.sum())
        j = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        wide = np.repeat(size[at], count)
        a, b = member[base + j // wide], member[base + j % wide]
        keep = (a != b) & (label[a] != label[b])
        a, b = a[keep], b[keep]
        hit = _apart(words[a], words[b], budget)
        if len(hit):
            label = _merged(label, a[hit], b[hit])
    for g in np.flatnonzero((size > SMALL) & (homes > 0)):
        group = np.unique(member[start[g] : start[g] + size[g]])
        piece = np.unique(label[group], return_inverse=True)[1]
        for i in np.searchsorted(group, np.unique(member[start[g] : start[g] + homes[g]])).tolist():
            rest = np.flatnonzero(piece != piece[i])  # those already connected need no comparison
            if not len(rest):
                break
            near = rest[_apart(np.broadcast_to(words[group[i]], (len(rest), WORDS)), words[group[rest]], budget)]
            if len(near):
                joined = np.zeros(len(group), bool)
                joined[piece[near]] = True
                piece[joined[piece]] = piece[i]
        first = np.unique(piece, return_index=True)
        label = _merged(label, group, group[first[1][np.searchsorted(first[0], piece)]])
    return label


def _candidates(nodes: DataFrame, n: int, budget: int) -> DataFrame:
    """fp, root: spanning stars of the candidate pairs among nodes (doc_id, words, narrow)."""

    def run(key, table):
        parts = []
        base = 0
        for r in table.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            code = np.frombuffer(r["leaf"], np.uint32).astype(np.int64)
            parts.append((ids, np.frombuffer(r["words"], np.uint64).reshape(-1, WORDS), np.frombuffer(r["member"], np.uint32).astype(np.int64) + base, code >> 1, (code & 1).astype(bool)))
            base += len(ids)
        ids, words, member, leaf, own = (np.concatenate(x) for x in zip(*parts))
        label = leaf_links(leaf, own, member, words, budget)
        a = np.flatnonzero(label != np.arange(len(label)))
        b = label[a]
        found = pa.table({"fp": np.maximum(ids[a], ids[b]), "root": np.minimum(ids[a], ids[b])})
        del parts, ids, words, member, leaf, own
        trim()
        return found

    return nodes.mapInArrow(_leaf_step(n), _LEAF_SQL).groupBy("shard").applyInArrow(run, "fp long, root long").distinct()


def set_links(sets: list[np.ndarray], similarity: float, first: int | None = None) -> np.ndarray:
    """Smallest index connected to each of these sets (sorted distinct hashes) over pairs whose Jaccard similarity reaches
    the threshold. With `first`, only pairs of one of the first so many sets and one of the others count."""
    m = len(sets)
    label, size = np.arange(m), np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(label, size)
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = max(CLOSEST, m // 8)  # beyond so many owners, a shingle is a column of a matrix
    place = np.full(len(df), -1)
    wide = np.flatnonzero(df > many)
    place[wide] = np.arange(len(wide))
    matrix = np.zeros((m, len(wide)), np.uint8)
    at = place[code]
    matrix[owner[at >= 0], at[at >= 0]] = 1
    rare = (at < 0) & (df[code] > 1)
    owner, code = owner[rare], code[rare]
    starts = np.searchsorted(owner, np.arange(m + 1))
    order = np.argsort(code, kind="stable")
    posts = owner[order]
    begin, count = np.searchsorted(code[order], code), df[code]
    rows, above = (m if first is None else first), np.arange(m)
    step = max(1, min(256, PAIR_BLOCK // m))
    for low in range(0, rows, step):
        if (label == label[0]).all():
            break
        high = min(low + step, rows)
        common = np.zeros((high - low, m), np.float32)
        for c in range(0, m, 1024) if len(wide) else ():
            common[:, c : c + 1024] = matrix[low:high].astype(np.float32) @ matrix[c : c + 1024].astype(np.float32).T
        for i in range(low, high):
            n = count[starts[i] : starts[i + 1]]
            if len(n):
                flat = np.arange(int(n.sum())) + np.repeat(begin[starts[i] : starts[i + 1]] - (np.cumsum(n) - n), n)
                common[i - low] += np.bincount(posts[flat], minlength=m)
        both = common.astype(np.int64)
        near = both / np.maximum(1, size[low:high, None] + size[None, :] - both) >= similarity
        near &= (above[None, :] > above[low:high, None]) if first is None else (above[None, :] >= first)
        a, b = np.nonzero(near)
        if len(a):
            label = _merged(label, a + low, b)
    return label


def _set_step(width: int, seed: int):
    """Members of blobs with their shingle sets, equal rows once in a task."""

    def run(batches):
        seen = set()
        for b in sliced(batches, 512):
            sets = [_hashes(x, width, seed).tobytes() for x in b.column("text").to_pylist()]
            keys = [(i, hashlib.blake2b(x, digest_size=16).digest()) for i, x in zip(b.column("doc_id").to_pylist(), sets)]
            new = [not (k in seen or seen.add(k)) for k in keys]
            kept = [b.column(c) for c in ("doc_id", "blob", "cells")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sets, pa.binary())], names=["doc_id", "blob", "cells", "hashes"]).filter(pa.array(new, pa.bool_()))
        trim()

    return run


def verified(members: DataFrame, texts: DataFrame, n: int, width: int, similarity: float, seed: int) -> DataFrame:
    """fp, root: spanning stars of the pairs of a blob whose texts are as similar as that. members: doc_id, blob, cells.
    Only their texts are read on; they are picked out where they are read if the ids are at most BROADCAST_IDS."""
    few = members.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = texts.join(F.broadcast(members) if few else members, "doc_id").select("doc_id", "text", "blob", "cells")
    sets = own.mapInArrow(_set_step(width, seed), "doc_id long, blob long, cells int, hashes binary")
    cell = F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int")
    dealt = sets.withColumn("cell", cell).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    tiled = dealt.select("doc_id", "blob", "cell", "hashes", F.least("cell", "other").alias("a"), F.greatest("cell", "other").alias("b"), "cells")
    tile = F.when(F.col("cells") == 1, F.pmod(F.xxhash64("blob"), F.lit(n))).otherwise(n + F.pmod(F.xxhash64("blob", "a", "b"), F.lit(1 << 40)))
    keyed = tiled.select(tile.cast("long").alias("shard"), "doc_id", "blob", "cell", "a", "b", "hashes")

    def run(key, table):
        groups = {}
        for r in zip(*(table.column(c).to_pylist() for c in ("blob", "a", "b", "cell", "doc_id", "hashes"))):
            groups.setdefault(r[:3], set()).add(r[3:])
        fp, root = [], []
        for (_, a, b), rows in groups.items():
            rows = sorted(rows)
            first = None if a == b else sum(x[0] == a for x in rows)
            if len(rows) < 2 or first in (0, len(rows)):
                continue
            label = set_links([np.frombuffer(x[2], np.uint64) for x in rows], similarity, first)
            for i in np.flatnonzero(label != np.arange(len(rows))).tolist():
                x, y = rows[i][1], rows[label[i]][1]
                if x != y:
                    fp.append(max(x, y))
                    root.append(min(x, y))
        found = pa.table({"fp": pa.array(fp, pa.int64()), "root": pa.array(root, pa.int64())})
        del groups, table
        trim()
        return found

    return keyed.groupBy("shard").applyInArrow(run, "fp long, root long").distinct()


def similar_links(docs: DataFrame, width: int, similarity: float, seed: int) -> DataFrame:
    """fp, root: edges between doc_ids of documents whose similarity reaches the threshold, as many as connect them."""
    rows = text_table(docs).where("doc_id is not null")
    n, budget = tasks_for(rows, SHARD_BYTES), budget_of(similarity, SPARE)
    prints = materialise(rows.mapInArrow(_wide_step(width, seed), "doc_id long, words binary, narrow binary, digest binary, shingles long"), "simhash-wide")
    nodes = materialise(prints.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("words", "narrow", "shingles")]), "simhash-nodes")
    equal = salted_lookup(prints.select(F.col("doc_id").alias("fp"), "digest"), nodes.select("digest", F.col("doc_id").alias("root")), "digest", "fp", how="inner").select("fp", "root").where("fp <> root").distinct()
    found = materialise(_candidates(nodes.select("doc_id", "words", "narrow"), n, budget), "simhash-pairs")
    if found.where("fp <> root").isEmpty():
        return equal
    blobs = components(found).select(F.col("node").alias("doc_id"), F.col("root").alias("blob"))
    placed = materialise(blobs.union(blobs.select(F.col("blob").alias("doc_id"), "blob")).distinct(), "simhash-blobs")
    held = placed.join(nodes.groupBy("doc_id").agg(F.sum("shingles").alias("shingles")), "doc_id")
    sizes = materialise(held.groupBy("blob").agg(F.sum("shingles").alias("shingles")), "simhash-sizes")
    total = sizes.agg(F.coalesce(F.sum("shingles"), F.lit(0)).alias("n")).first().n
    tasks = max(1, -(-total // CELL), min(docs.sparkSession.sparkContext.defaultParallelism, total >> 16))
    members = materialise(salted_lookup(placed, sizes.select("blob", F.ceil(F.greatest("shingles", F.lit(1)) / CELL).cast("int").alias("cells")), "blob", "doc_id", how="inner").select("doc_id", "blob", "cells"), "simhash-members")
    return materialise(verified(members, rows, tasks, width, similarity, seed), "simhash-edges").union(equal).distinct()


def representatives(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """Rows of docs whose doc_id is the smallest of its group of near duplicates, and rows with a null doc_id. Only ids
    are joined."""
    gone = components(similar_links(docs, width, similarity, seed)).where("node <> root").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti")
