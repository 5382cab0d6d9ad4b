"""Removal of repeated byte strings with difference-cover suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Suffixes are
sorted with the difference-cover algorithm (DC3): triples at positions 1 and 2 modulo 3 are sorted and named, names are
sorted by recursion, the remaining suffixes are merged in, and neighbours in the order are compared on their first
LENGTH bytes.

The sort itself runs inside tasks, on blocks of about SORT bytes; what is distributed is the text, cut so that equal
strings always meet in one block. So this is the difference-cover algorithm over a distributed text, not one sort that
spans the cluster. Every string of LENGTH bytes is owned by its smallest SEED-byte substring (by hash, leftmost of
equals), so equal strings have equal owners. Strings with one owner that start side by side travel as one context. Four
steps, each a job over hash-dealt blocks:
1. owners of every document block, with smallest and largest doc_id; owners seen in two documents are shared,
2. contexts of shared owners, each once for a block of documents, to the owner's task,
3. there: DC3 over the distinct contexts; each string learns the smallest doc_id that it starts in,
4. blocks of documents apply this to their occurrences.
So a passage in a third of all documents is one context for each block, not one row for each document. An owner with
over HOT occurrences has its strings dealt one by one, by their own hash, as its contexts may all differ. The number of
blocks follows the bytes of text (BLOCK_BYTES each), so a task's share does not grow with the corpus.

Numbers travel as sorted, byte-plane-wise compressed arrays. Only Spark reads and writes files.

Defined results: null text is empty; texts under LENGTH bytes keep all; rows with equal doc_id are one document, so
neither loses to the other; rows with a null doc_id have no place in the order, so they keep all and take nothing from
others; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import materialise, release_shuffles, tasks_for, text_table

LENGTH, SEED, HOT = 50, 20, 20_000
#: Bytes of text of a block of documents.
BLOCK_BYTES = 16 << 20
#: Bytes of text that are hashed at a time (a bound on arrays; a longer text is cut with overlap), and bytes of
#: contexts that are sorted together.
SLICE, SORT = 1 << 15, 1 << 21
_PLACE = np.uint64((1 << 24) - 1)
_TABLE = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def pack(values: np.ndarray, ordered: bool = False) -> bytes:
    """64-bit integers; differences if sorted; byte planes; zstd."""
    x = values.astype(np.uint64)
    if ordered and len(x):
        x = np.r_[x[:1], np.diff(x)]
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, ordered: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)
    return np.cumsum(x, dtype=np.uint64) if ordered else x


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Integers start .. start + size - 1 of all ranges, concatenated."""
    ahead = np.cumsum(size) - size
    return np.repeat(start - ahead, size) + np.arange(int(size.sum()))


def _rolling(x: np.ndarray, width: int) -> np.ndarray:
    """Hash of every substring of `width` bytes, put together from powers of two."""
    step, have, out = _TABLE[x], 0, None
    factor, size = np.uint64(0x9E3779B97F4A7C15), 1
    scale = factor
    while size <= width:
        if width & size:
            if out is None:
                out, have = step, size
            else:
                out, have = out[: len(step) - have] * scale + step[have:], have + size
        step = step[:-size] * scale + step[size:] if len(step) > size else step[:0]
        scale, size = np.uint64(int(scale) ** 2 % 2**64), size * 2
    out = out[: max(0, len(x) - width + 1)]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    m, size = x, 1
    while size * 2 <= width:
        m, size = np.minimum(m[:-size], m[size:]), size * 2
    return np.minimum(m[: len(x) - width + 1], m[width - size :][: len(x) - width + 1])


def owners(x: np.ndarray, start: np.ndarray, size: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """For texts at start, size in x: hash of each owner, first and last string (by its start) that it owns, its text."""
    none = np.zeros(0, np.int64)
    if len(x) < length:
        return none.astype(np.uint64), none, none, none
    h = _rolling(x, seed)
    best = _window_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - seed + 1)
    fits = np.maximum(size - length + 1, 0)
    s = ragged(start, fits)
    text = np.repeat(np.arange(len(start)), fits)
    if not len(s):
        return none.astype(np.uint64), none, none, none
    at = (best[s] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    return h[at[first]], s[first], s[np.r_[first[1:], len(s)] - 1], text[first]


def _slices(ids: list[int], texts: list[str], length: int = LENGTH):
    """(bytes of some texts together, start, size, index of each text, offset in it). Long texts overlap in length - 1."""
    held, width = [], 0

    def out():
        size = np.array([len(p) for _, _, p in held], np.int64)
        joined = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        return joined, np.cumsum(size) - size, size, np.array([i for i, _, _ in held], np.int64), np.array([o for _, o, _ in held], np.int64)

    for i, text in enumerate(texts):
        raw = text.encode("utf-8")
        for at in range(0, max(1, len(raw) - length + 1), SLICE):
            part = raw[at : at + SLICE + length - 1]
            if held and width + len(part) > SLICE:
                yield out()
                held, width = [], 0
            held.append((i, at, part))
            width += len(part)
    if held:
        yield out()


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Difference-cover suffix array of positive integers."""
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    wide = np.r_[t.astype(np.int64), 0, 0, 0]
    base = int(wide.max()) + 1
    sample = np.r_[np.arange(1, n, 3), np.arange(2, n, 3)]
    ones = len(range(1, n, 3))
    if base < 1 << 20:
        triple = (wide[sample] * base + wide[sample + 1]) * base + wide[sample + 2]
    else:
        pair = np.unique(wide[sample] * base + wide[sample + 1], return_inverse=True)[1]
        triple = pair * base + wide[sample + 2]
    if base**3 <= 1 << 22:  # few symbols: triples are counted, not compared
        seen = np.zeros(base**3, bool)
        seen[triple] = True
        name = (np.cumsum(seen) - 1)[triple]
        kinds = int(seen.sum())
    else:
        order = np.argsort(triple)
        found = triple[order]
        new = np.r_[False, found[1:] != found[:-1]]
        name = np.empty(len(triple), np.int64)
        name[order] = np.cumsum(new)
        kinds = int(new.sum()) + 1
    if kinds == len(sample):
        order = np.argsort(name)
    else:
        found = suffix_array(np.r_[name[:ones] + 2, 1, name[ones:] + 2])
        found = found[found != ones]
        order = np.where(found > ones, found - 1, found)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    top = len(sample) + 2
    rest = np.arange(0, n, 3)
    key = wide[rest] * top + rank[rest + 1]
    rest = rest[np.argsort(key, kind="stable")]
    one, two = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    lead = np.r_[wide[rest] * base + wide[rest + 1], wide[two] * base + wide[two + 1]]
    if base * base * top >= 1 << 62:
        lead = np.unique(lead, return_inverse=True)[1]
    before = np.searchsorted(wide[one] * top + rank[one + 1], wide[rest] * top + rank[rest + 1])
    before += np.searchsorted(lead[len(rest) :] * top + rank[two + 2], lead[: len(rest)] * top + rank[rest + 2])
    out = np.empty(n, np.int64)
    place = before + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sorted_sample
    return out


def smallest_documents(contexts: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each distinct context, the smallest doc of every string of `length` bytes in it."""
    size = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"\0".join(contexts) + b"\0" * length, np.uint8)
    start = np.cumsum(size + 1) - (size + 1)
    own = text[: int((size + 1).sum())]
    symbols = (np.cumsum(np.bincount(own, minlength=256) > 0) + 1)[own]  # the bytes that occur, numbered in order
    symbols[start + size] = 1
    strings = size - length + 1
    valid = np.zeros(len(symbols), bool)
    where = ragged(start, strings)
    valid[where] = True
    of = np.zeros(len(symbols), np.int64)
    of[where] = np.repeat(np.arange(len(contexts)), strings)
    order = suffix_array(symbols)
    order = order[valid[order]]
    new = np.ones(len(order), bool)
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    for k in range(0, len(order), 1 << 16):
        rows = view[order[max(0, k - 1) : k + (1 << 16)]]
        same = (rows[1:] == rows[:-1]).all(1)
        new[max(1, k) : max(0, k - 1) + len(rows)] = ~same
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[of[order]], first)
    result = np.zeros(len(symbols), np.int64)
    result[order] = np.repeat(least, np.diff(np.r_[first, len(order)]))
    return [result[a : a + n] for a, n in zip(start, strings)]


def _grouped(keys: np.ndarray, *columns):
    """keys sorted and unique; columns as (values, ufunc) reduced within each key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return (k[first], *((how.reduceat(v[order], first) if len(k) else v) for v, how in columns))


_OWNER_SQL = "shard int, owner binary, block binary, low binary, span binary, docs binary"
_SHARED_SQL = "block int, owner binary, hot binary"
_CONTEXT_SQL = "shard int, block int, owner binary, low binary, span binary, size binary, hot binary, context binary"
_LEAST_SQL = "block int, owner binary, hot binary, name binary, strings binary, least binary"


def _tables(schema: str, rows: list[tuple]) -> pa.Table:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.table({n: pa.array([r[i] for r in rows], pa.int32() if k == "int" else pa.binary()) for i, (n, k) in enumerate(zip(names, kinds))})


def _owner_step(length: int, seed: int, n: int):
    """Per batch and owner and block of documents: smallest and largest doc_id, occurrences."""

    def run(batches):
        for b in batches:
            ids, block, texts = b.column("doc_id").to_numpy(), b.column("block").to_numpy(), b.column("text").to_pylist()
            found: list = []
            for x, start, size, text, _ in _slices(ids, texts, length):
                h, _, _, t = owners(x, start, size, length, seed)
                found.append((h, text[t]))
            if not found:
                continue
            h, text = (np.concatenate(f) for f in zip(*found))
            order = np.lexsort((block[text], h))
            h, doc, own = h[order], ids[text[order]], block[text[order]]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]) if len(h) else np.zeros(0, np.int64)
            if not len(first):
                continue
            low, high, many = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first), np.diff(np.r_[first, len(h)])
            h, own = h[first], own[first]
            shard = (h % np.uint64(n)).astype(np.int64)
            rows = []
            for s in range(n):
                at = np.flatnonzero(shard == s)
                if len(at):
                    rows.append((s, pack(h[at], True), pack(own[at]), pack(low[at]), pack(high[at] - low[at]), pack(many[at])))
            yield from _tables(_OWNER_SQL, rows).to_batches()

    return run


def _shared_step(hot: int):
    """To each block of documents: its owners that are in two documents."""

    def run(key, table):
        cols = [np.concatenate([unpack(x, c == "owner") for x in table.column(c).to_pylist()]) for c in ("owner", "block", "low", "span", "docs")]
        h, block, low, span, many = cols[0], *(c.view(np.int64) for c in cols[1:])
        keys, least, most, total = _grouped(h, (low, np.minimum), (low + span, np.maximum), (many, np.add))
        ok = least < most
        shared, crowded = keys[ok], total[ok] > hot
        if not len(shared):
            return _tables(_SHARED_SQL, [])
        at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        hit = np.flatnonzero(shared[at] == h)
        order = hit[np.lexsort((at[hit], block[hit]))]
        at, block = at[order], block[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (block[1:] != block[:-1])]
        at, block = at[new], block[new]
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        return _tables(_SHARED_SQL, [(int(block[i]), pack(shared[at[i:j]], True), pack(crowded[at[i:j]].astype(np.int64))) for i, j in zip(cut, np.r_[cut[1:], len(at)])])

    return run


def _occurrences(ids, texts, known: np.ndarray, crowded: np.ndarray, length: int, seed: int):
    """(bytes, text, owner, first string, last string, offset of the slice) of every context of a known owner; a
    crowded owner's strings one by one."""
    for x, start, size, text, offset in _slices(ids, texts, length):
        h, a, b, t = owners(x, start, size, length, seed)
        if not len(h) or not len(known):
            continue
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        ok = known[at] == h
        h, a, b, t, many = h[ok], a[ok], b[ok], t[ok], crowded[at[ok]]
        if many.any():
            n = np.where(many, b - a + 1, 1)
            single = np.repeat(many, n)
            s = ragged(a, n)
            h, t, last = np.repeat(h, n), np.repeat(t, n), np.repeat(b, n)
            a = np.where(single, s, np.repeat(a, n))
            b = np.where(single, s, last)
        yield x, text[t], h, a, b, offset[t] - start[t]


def _shared_of(flags) -> tuple[np.ndarray, np.ndarray]:
    if not flags.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.concatenate([unpack(x, True) for x in flags.column("owner").to_pylist()])
    hot = np.concatenate([unpack(x) for x in flags.column("hot").to_pylist()]).astype(bool)
    order = np.argsort(h, kind="stable")
    return h[order], hot[order]


def _context_step(length: int, seed: int, n: int):
    def run(key, docs, flags):
        ids, texts = docs.column("doc_id").to_numpy(), docs.column("text").to_pylist()
        known, crowded = _shared_of(flags)
        held: dict[bytes, list] = {}
        for x, text, h, a, b, _ in _occurrences(ids, texts, known, crowded, length, seed):
            raw = x.tobytes()
            for owner, doc, i, j in zip(h.tolist(), ids[text].tolist(), a.tolist(), (b + length).tolist()):
                c = raw[i:j]
                old = held.get(c)
                if old is None:
                    held[c] = [owner, doc, doc]
                elif doc < old[1]:
                    old[1] = doc
                elif doc > old[2]:
                    old[2] = doc
        block = key[0].as_py()
        hot = set(known[crowded].tolist())
        dealt: dict[int, list] = {}
        for c, v in held.items():
            by = xxhash.xxh64_intdigest(c) if v[0] in hot else v[0]
            dealt.setdefault(by % n, []).append((v[0], v[1], v[2], c))
        rows = []
        for s, own in dealt.items():
            own.sort()
            cols = [np.array([o[i] for o in own], np.uint64 if i == 0 else np.int64) for i in range(3)]
            text = b"".join(o[3] for o in own)
            single = np.array([o[0] in hot for o in own], np.int64)
            rows.append((s, block, pack(cols[0], True), pack(cols[1]), pack(cols[2] - cols[1]), pack(np.array([len(o[3]) for o in own])), pack(single), zstandard.ZstdCompressor(level=3).compress(text)))
        return _tables(_CONTEXT_SQL, rows)

    return run


def _least_step(length: int):
    def run(key, table):
        least: dict[bytes, list] = {}
        asked = []
        for r in table.to_pylist():
            owner, low = unpack(r["owner"], True), unpack(r["low"]).view(np.int64)
            high, size, hot = low + unpack(r["span"]).view(np.int64), unpack(r["size"]).view(np.int64), unpack(r["hot"])
            text = zstandard.ZstdDecompressor().decompress(r["context"])
            end = np.cumsum(size).tolist()
            own = [text[e - k : e] for e, k in zip(end, size.tolist())]
            asked.append((r["block"], owner, hot, high, own))
            for c, o, one, d in zip(own, owner.tolist(), hot.tolist(), low.tolist()):
                old = least.get(c)
                if old is None:
                    least[c] = [xxhash.xxh64_intdigest(c) if one else o, d]
                elif d < old[1]:
                    old[1] = d
        names = sorted(least, key=lambda c: least[c][0])
        result: dict[bytes, tuple] = {}  # smallest documents, and the smallest of these
        # An owner's only context needs no order: its strings are nowhere else.
        of = np.array([least[c][0] for c in names], np.uint64)
        alone = np.r_[True, of[1:] != of[:-1]] & np.r_[of[1:] != of[:-1], True] if len(names) else np.zeros(0, bool)
        result.update((names[i], (np.full(len(names[i]) - length + 1, least[names[i]][1]), least[names[i]][1])) for i in np.flatnonzero(alone).tolist())
        names = [names[i] for i in np.flatnonzero(~alone).tolist()]
        i = 0
        while i < len(names):  # owners stay whole; a block of them is sorted at a time
            j, width = i, 0
            while j < len(names) and (width < SORT or least[names[j]][0] == least[names[j - 1]][0]):
                width += len(names[j]) + 1
                j += 1
            some = names[i:j]
            result.update((c, (x, int(x.min()))) for c, x in zip(some, smallest_documents(some, np.array([least[c][1] for c in some], np.int64), length)))
            i = j
        rows = []
        for block, owner, hot, high, own in asked:
            found = [(o, c, result[c][0], one) for o, one, h, c in zip(owner.tolist(), hot.tolist(), high.tolist(), own) if result[c][1] < h]
            if found:
                name = b"".join(xxhash.xxh3_128_digest(f[1]) for f in found)
                rows.append((block, pack(np.array([f[0] for f in found], np.uint64), True), pack(np.array([f[3] for f in found])), name, pack(np.array([len(f[2]) for f in found])), pack(np.concatenate([f[2] for f in found]))))
        return _tables(_LEAST_SQL, rows)

    return run


_RESULT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _removal_step(length: int, seed: int, outputs: bool):
    def run(key, docs, answers):
        ids, texts = docs.column("doc_id").to_numpy(), docs.column("text").to_pylist()
        owner, hot, names, strings, least = [], [], {}, [], []
        for r in answers.to_pylist():
            o, n = unpack(r["owner"], True), unpack(r["strings"]).view(np.int64)
            for k in range(len(o)):
                names[r["name"][16 * k : 16 * k + 16]] = len(names)
            owner.append(o)
            hot.append(unpack(r["hot"]))
            strings.append(n)
            least.append(unpack(r["least"]).view(np.int64))
        many: dict[int, list] = {}
        if names:
            owner, hot, strings, least = map(np.concatenate, (owner, hot, strings, least))
            first = np.cumsum(strings) - strings
            known, crowded = _grouped(owner, (hot, np.maximum))
            for x, text, h, a, b, shift in _occurrences(ids, texts, known, crowded.astype(bool), length, seed):
                raw = x.tobytes()
                digest = xxhash.xxh3_128_digest
                hit = np.array([names.get(digest(raw[i:j]), -1) for i, j in zip(a.tolist(), (b + length).tolist())], np.int64)
                ok = hit >= 0
                hit, n = hit[ok], (b - a + 1)[ok]
                doc = np.repeat(ids[text[ok]], n)
                gone = least[ragged(first[hit], n)] < doc
                s = ragged((a + shift)[ok], n)[gone]
                t = np.repeat(text[ok], n)[gone]
                each, cut = np.unique(t, return_index=True)  # t ascends
                for i, own in zip(each.tolist(), np.split(s, cut[1:])):
                    many.setdefault(i, []).append(own)
        out = []
        for i, text in enumerate(texts):
            raw = text.encode("utf-8")
            spans: list = []
            if i in many:
                s = np.sort(np.concatenate(many[i]))
                cut = np.flatnonzero(np.r_[True, s[1:] > s[:-1] + length])
                spans = list(zip(s[cut].tolist(), (s[np.r_[cut[1:], len(s)] - 1] + length).tolist()))
            at, kept = 0, []
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append((int(ids[i]), len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if outputs else None, [{"start": a, "end": b} for a, b in spans] if outputs else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), _SPANS)
        names_ = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")
        return pa.table({n: pa.array([o[k] for o in out], t) for k, (n, t) in enumerate(zip(names_, kinds))})

    return run


def deduplicate(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT, outputs: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with outputs, the kept bytes and the removed spans."""
    spark = docs.sparkSession
    known = text_table(docs).where("doc_id is not null")
    n = tasks_for(known, BLOCK_BYTES)
    rows = known.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    dealt = rows.mapInArrow(_owner_step(length, seed, n), _OWNER_SQL)
    shared = materialise(dealt.groupBy("shard").applyInArrow(_shared_step(hot), _SHARED_SQL), "owners")
    del dealt
    release_shuffles(spark)
    contexts = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_context_step(length, seed, n), _CONTEXT_SQL)
    least = materialise(contexts.groupBy("shard").applyInArrow(_least_step(length), _LEAST_SQL), "least")
    del contexts
    release_shuffles(spark)
    done = rows.groupBy("block").cogroup(least.groupBy("block")).applyInArrow(_removal_step(length, seed, outputs), _RESULT_SQL)
    whole = F.encode("text", "UTF-8")
    spans = "array<struct<start:bigint,end:bigint>>"
    lone = text_table(docs).where("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"),
        (whole if outputs else F.lit(None).cast("binary")).alias("kept"), (F.array().cast(spans) if outputs else F.lit(None).cast(spans)).alias("spans"),
    )
    return done.union(lone)
