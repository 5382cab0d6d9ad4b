"""SentencePiece BPE with seeded merge-dropout.

A text becomes a leading space and its characters; merges join neighbours whose concatenation is a piece, the best score
first and the leftmost of equals, as an agenda would hand them out. With dropout each candidate merge, named by the word
and the span it would cover, is skipped for good if a keyed hash of (seed, variant, word, span) falls below `rate`.
Variants alternate over a document's words, so one word is segmented in several ways, always the same for one seed.
Characters without a piece become byte pieces, and so does a literal U+2581, which makes decoding lossless.

No piece holds a space after another character, so words (with the spaces before them) are segmented on their own.
Distinct (word, variant) pairs of a chunk of texts are segmented together as arrays: every round merges the first
agenda entry of every word. Words over LONG characters use a heap each, which keeps them near-linear.

Defined results: null or empty text has no pieces and decodes to the empty text; rows with a null doc_id use key 0;
repeated rows get equal pieces; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from kinlink.llm.common import text_table, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, RATE, VARIANTS = 20, 0.1, 4
LONG = 48
#: Words of texts that are segmented together.
CHUNK = 400_000
NEVER = np.int64(1) << 40
_RUNS = re.compile(" +[^ ]*")
_BYTE0 = "<0x00>"


def load_vocabulary(path: str = MODEL) -> dict:
    """Arrays of the model: piece bytes, the piece of each character, merges by key, ranks. Bounded by the vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    text = {}
    data = [b""] * size
    for i in range(size):
        if sp.is_byte(i):
            data[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            piece = sp.id_to_piece(i).replace("▁", " ")
            text[piece] = i
            data[i] = piece.encode("utf-8")
    chars = np.full(0x110000, -1, np.int32)
    keys, merged = [], []
    for piece, i in text.items():
        if len(piece) == 1:
            chars[ord(piece)] = i
        for cut in range(1, len(piece)):
            a, b = text.get(piece[:cut]), text.get(piece[cut:])
            if a is not None and b is not None:
                keys.append(a * size + b)
                merged.append(i)
    order = np.argsort(np.array(keys, np.int64))
    # Scores fall from piece to piece; equal scores share a rank, so that the leftmost goes first.
    score = np.array([sp.get_score(i) for i in range(size)])
    rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
    return {"size": size, "byte0": sp.piece_to_id(_BYTE0), "chars": chars, "keys": np.array(keys, np.int64)[order], "merged": np.array(merged, np.int32)[order], "rank": rank, "data": data}


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _span_hash(base: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix(base ^ _mix((start.astype(np.uint64) << np.uint64(32)) | end.astype(np.uint64)))


class Segmenter:
    def __init__(self, vocabulary: dict, rate: float = RATE, seed: int = SEED, variants: int = VARIANTS):
        self.v, self.seed, self.variants = vocabulary, seed, max(1, variants)
        self.limit = np.uint64(int(min(max(rate, 0.0), 1.0) * (2**64 - 2048)))
        data = vocabulary["data"]
        self.flat = np.frombuffer(b"".join(data), np.uint8)
        self.size = np.array([len(x) for x in data], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged piece of each pair, -1 where there is none. Negative symbols are characters without a piece."""
        keys = self.v["keys"]
        key = a.astype(np.int64) * self.v["size"] + b
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (keys[i] == key), self.v["merged"][i], -1)

    def _ranked(self, merged: np.ndarray, base: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        rank = np.where(merged >= 0, self.v["rank"][merged], NEVER)
        if self.limit:
            rank[(merged >= 0) & (_span_hash(base, start, end) < self.limit)] = NEVER
        return rank

    def base(self, words: list[str], variant: np.ndarray) -> np.ndarray:
        own = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8"), self.seed) for w in words), np.uint64, len(words))
        return _mix(own + variant.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def segment(self, words: list[str], variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all words, concatenated, and the number of each word's."""
        base = self.base(words, variant)
        size = np.fromiter(map(len, words), np.int64, len(words))
        long = size > LONG
        short = np.flatnonzero(~long)
        sym, of = self._rounds([words[i] for i in short], base[short])
        found_sym, found_of = [sym], [short[of]]
        for i in np.flatnonzero(long):
            own = self._agenda(words[i], int(base[i]))
            found_sym.append(own)
            found_of.append(np.full(len(own), i, np.int64))
        sym, of = np.concatenate(found_sym), np.concatenate(found_of)
        order = np.argsort(of, kind="stable")
        return self._with_bytes(sym[order], of[order], len(words))

    def _with_bytes(self, sym: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        lost = np.flatnonzero(sym < 0)
        if len(lost):
            raw = [chr(-1 - int(c)).encode("utf-8") for c in sym[lost]]
            width = np.ones(len(sym), np.int64)
            width[lost] = [len(x) for x in raw]
            at = np.cumsum(width) - width
            out = np.repeat(sym, width)
            for k, x in zip(at[lost], raw):
                out[k : k + len(x)] = np.frombuffer(x, np.uint8).astype(np.int32) + self.v["byte0"]
            sym, of = out, np.repeat(of, width)
        return sym, np.bincount(of, minlength=n)

    def _symbols(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.v["chars"][code]
        return np.where((sym < 0) | (code == 0x2581), -1 - code, sym).astype(np.int32)

    def _rounds(self, words: list[str], base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self._symbols("".join(words))
        of = np.repeat(np.arange(len(words)), size)
        pos = np.arange(len(sym)) - np.repeat(np.cumsum(size) - size, size)
        done_sym, done_of = [], []

        def pairs(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Merged piece and rank of symbols i and i + 1."""
            nxt = np.minimum(i + 1, len(sym) - 1)
            joined = (i + 1 < len(sym)) & (of[nxt] == of[i])
            after = np.minimum(i + 2, len(sym) - 1)
            end = np.where((i + 2 < len(sym)) & (of[after] == of[i]), pos[after], size[of[i]])
            m = np.where(joined, self._lookup(sym[i], sym[nxt]), -1)
            return m, self._ranked(m, base[of[i]], pos[i], end)

        if len(sym):
            mid, rank = pairs(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(sym)])
            open_ = best < NEVER
            if not open_.all():
                stay = np.repeat(open_, count)
                done_sym.append(sym[~stay])
                done_of.append(of[~stay])
                sym, of, pos, mid, rank = (x[stay] for x in (sym, of, pos, mid, rank))
                if not len(sym):
                    break
                best, count = best[open_], count[open_]
            hit = np.flatnonzero(rank == np.repeat(best, count))
            j = hit[np.r_[True, of[hit][1:] != of[hit][:-1]]]
            sym[j] = mid[j]
            keep = np.ones(len(sym), bool)
            keep[j + 1] = False
            sym, of, pos, mid, rank = (x[keep] for x in (sym, of, pos, mid, rank))
            j = j - np.arange(len(j))
            mid[j], rank[j] = pairs(j)
            left = j[j > 0] - 1
            left = left[of[left] == of[left + 1]]
            mid[left], rank[left] = pairs(left)
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(done_sym), np.concatenate(done_of)

    def _agenda(self, word: str, base: int) -> np.ndarray:
        """One long word: a heap of candidate merges over a linked list of symbols."""
        sym = self._symbols(word).tolist()
        n = len(sym)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        one = np.array([base], np.uint64)
        heap: list = []

        def push(lefts: list[int]):
            lefts = [i for i in lefts if i >= 0 and nxt[i] < n]
            if not lefts:
                return
            i = np.array(lefts)
            m = self._lookup(np.array([sym[x] for x in lefts], np.int64), np.array([sym[nxt[x]] for x in lefts], np.int64))
            end = np.array([nxt[nxt[x]] for x in lefts])
            rank = self._ranked(m, np.repeat(one, len(i)), i, end)
            for x, r, piece in zip(lefts, rank.tolist(), m.tolist()):
                if r < NEVER:
                    heapq.heappush(heap, (r, x, nxt[x], sym[x], sym[nxt[x]], piece))

        push(list(range(n)))
        while heap:
            _, i, k, a, b, piece = heapq.heappop(heap)
            if not (alive[i] and alive[k]) or nxt[i] != k or sym[i] != a or sym[k] != b:
                continue
            sym[i], alive[k] = piece, False
            nxt[i] = nxt[k]
            if nxt[k] < n:
                prv[nxt[k]] = i
            push([prv[i], i])
        return np.array([s for s, ok in zip(sym, alive) if ok], np.int32)

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """The pieces of each text. keys choose where a text starts in the cycle of variants."""
        index: dict = defaultdict()
        index.default_factory = index.__len__
        flat: list[int] = []
        sizes = []
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            flat.extend(map(index.__getitem__, words))
        sizes_ = np.array(sizes, np.int64)
        word = np.array(flat, np.int64)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(sizes_) - sizes_, sizes_)
        key = np.repeat(np.array([k & (2**64 - 1) for k in keys], np.uint64), sizes_)
        variant = (_mix(key + nth.astype(np.uint64) + np.uint64(self.seed)) % np.uint64(self.variants)).astype(np.int64)
        each, at = np.unique(word * self.variants + variant, return_inverse=True)
        names = list(index)
        pieces, count = self.segment([names[i] for i in each // self.variants], each % self.variants)
        first = np.cumsum(count) - count
        out = ragged(pieces, first[at], count[at])
        cut = np.r_[0, np.cumsum(count[at])][np.r_[0, np.cumsum(sizes_)]]
        return [out[a:b] for a, b in zip(cut, cut[1:])]

    def decode(self, pieces: np.ndarray) -> str:
        raw = ragged(self.flat, self.at[pieces], self.size[pieces]).tobytes()
        return raw[1:].decode("utf-8") if raw else ""


def words_of(text: str) -> list[str]:
    """The text with its leading space, cut before each run of spaces."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _RUNS.findall(" " + text)
    return [" " + w for w in text.split(" ")]


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all ranges, concatenated."""
    total = int(size.sum())
    ahead = np.cumsum(size) - size
    return values[np.repeat(start - ahead, size) + np.arange(total)]


def chunks(texts: list[str], limit: int = CHUNK):
    """Ranges of texts with about `limit` words together, one text at least."""
    start, words = 0, 0
    for i, text in enumerate(texts):
        own = len(text) // 5 + 1
        if i > start and words + own > limit:
            yield start, i
            start, words = i, 0
        words += own
    if start < len(texts):
        yield start, len(texts)


def tokenise(docs: DataFrame, path: str = MODEL, rate: float = RATE, seed: int = SEED, variants: int = VARIANTS) -> DataFrame:
    """doc_id, pieces (ids), n_pieces, pieces_sha256 (ids as 32-bit little-endian), decoded_sha256 and lossless: what
    decoding the pieces gives, and whether that is the text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))  # as large as the vocabulary

    def run(batches):
        tool = Segmenter(vocabulary.value, rate, seed, variants)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for i, j in chunks(texts):
                rows = tool.encode(texts[i:j], [x or 0 for x in ids[i:j]])
                back = [tool.decode(x) for x in rows]
                size = np.array([len(x) for x in rows], np.int64)
                yield pa.record_batch(
                    [
                        pa.array(ids[i:j], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(np.concatenate(rows), pa.int32())),
                        pa.array(size),
                        pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in rows]),
                        pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in back]),
                        pa.array([x == y for x, y in zip(back, texts[i:j])]),
                    ],
                    names=["doc_id", "pieces", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"],
                )
        del tool
        vocabulary.__dict__.pop("_value", None)  # a worker outlives its task; the next one reads the broadcast's file again
        trim()

    return text_table(docs).mapInArrow(run, "doc_id long, pieces array<int>, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean")


def detokenise(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, pieces."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        tool = Segmenter(vocabulary.value)
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([tool.decode(np.array(x or [], np.int64)) for x in b.column("pieces").to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
