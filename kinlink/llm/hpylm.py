"""Hierarchical Pitman-Yor language model over word bigrams.

Every previous word u is a restaurant whose customers are the words seen after it; all of them share one parent, the
restaurant of words, whose base is uniform over the known words and one unknown. c customers of dish w sit at t tables
and each table is a customer of w in the parent, so

    p(w | u) = (c_uw - d t_uw + (a + d T_u) p(w)) / (a + C_u),

and likewise for p(w). Seating is sampled by Gibbs sweeps: given all else, a dish's table count has

    P(t | c) ~ S_d(c, t) (a + d T')(a + d (T' + 1)) ... (t factors) p(w)^t,   T': tables of the restaurant's other dishes,

with generalised Stirling numbers S_d, and is drawn from these weights whatever c: S_d comes from its recurrence up to
STIRLING customers and from a contour integral of its generating function beyond (relative errors of 1e-3 at most, 1e-9 as
a rule); where more than GRID values of t count, cells of neighbouring values are drawn and a value in the cell. T' leaves
out the dish's own tables in both levels. Within a sweep totals of restaurants and the parent's probabilities are those
of the sweep before, so all dishes are drawn side by side. The first seating has one table for each dish. Strengths of
both levels are sampled in the burn-in sweeps (auxiliary variables, Gamma(1, 1) prior) and then kept, so that the samples
share a model; predictive probabilities are averaged over the samples. Discounts come from counts of counts, n1 / (n1 + 2 n2).

Distribution: (u, w) pairs are dealt by their own hash, so no restaurant and no word is ever in one task; words are dealt
by hash too. A sweep is two jobs: pair tasks draw seats and send each word task one line per word with its tables as
restaurant and as dish; word tasks add up, draw the parent's seats and answer. What a frequent word costs is one line
per pair task. Lines and pairs travel as compressed arrays, and each sweep is a table in the shared folder. The number of
tasks follows the bytes of text (SHARD_BYTES a pair task), so a task's share does not grow with the corpus.

Words are named by 48 bits of their XXH64. Defined results: null or empty text is one end token; rows with a null doc_id
are training text; rows are scored each, and repeated rows count as often as they occur; without training text the base
decides; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import drop_path, materialise, release_shuffles, scratch_path, tasks_for, trim

BURN_IN, SAMPLES, STRENGTH, SEED = 2, 3, 1.0, 11
#: Customers up to which Stirling numbers come from a table, values of t that are weighed beyond it, bytes of a pair task.
STIRLING, GRID, SHARD_BYTES = 256, 32, 12 << 20
#: Parts of the texts that are scored one after the other, so that only a part's tokens are on disk at a time.
PARTS = 2
#: Names of the end token and of the context at a text's start; tokens that are counted together in a task.
END, START, CHUNK = 1, 2, 3 << 18
_MASK = (1 << 48) - 1
#: Above this many combinations of text and pair in a chunk, they do not fit one number and are sorted by columns.
WIDE = 1 << 62
#: Partial sums of logarithms travel as integers in units of 2 ** -30, so they add up the same in any order.
FIXED = float(1 << 30)
MESSAGE_SQL = "kind int, shard int, src long, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary, b5 binary, b6 binary"
STATE, LINES, ANSWER, TOTAL, TOKENS, TEXTS, WORDS = range(7)


def pack(x: np.ndarray, ordered: bool = False) -> bytes:
    if x.dtype == np.float64:
        x = x.view(np.int64)
    width = 4 if not ordered and (not len(x) or (int(x.min()) >= 0 and int(x.max()) < 2**32)) else 8
    x = x.astype(np.uint32 if width == 4 else np.uint64)
    if ordered and len(x):
        x = np.r_[x[:1], np.diff(x)]
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, ordered: bool = False) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    x = np.ascontiguousarray(planes.T).view(np.uint32 if width == 4 else np.uint64).reshape(-1).astype(np.int64)
    return np.cumsum(x) if ordered else x


def _messages(rows: list[tuple]) -> pa.Table:
    cols = [pa.array([r[i] if i < len(r) else None for r in rows], pa.int32() if i < 2 else pa.int64() if i == 2 else pa.binary()) for i in range(10)]
    return pa.table(cols, names=[x.split()[0] for x in MESSAGE_SQL.split(", ")])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def _tokens(texts: list[str | None]):
    """Sorted names of words, and for each token: its word, the word before it, its text. Ends are tokens."""
    index: dict = defaultdict()
    index.default_factory = index.__len__
    parts, size = [], []
    for text in texts:
        words = words_of(text)
        size.append(len(words) + 1)
        parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
        parts.append(np.array([-1], np.int32))
    names = np.array([xxhash.xxh64_intdigest(w) & _MASK for w in index] + [START, END], np.int64)
    del index
    order = np.argsort(names)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    w = place[np.concatenate(parts)]  # -1: the end, which is the last name
    size = np.array(size, np.int64)
    u = np.r_[0, w[:-1]]
    u[np.cumsum(size) - size] = place[-2]
    return names[order], w, u, np.repeat(np.arange(len(texts)), size)


def _chunks(column: pa.Array, limit: int = CHUNK):
    """Ranges of texts with about `limit` words together, one text at least."""
    size = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False) // 6 + 1)
    start = 0
    while start < len(size):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit)))
        yield start, end
        start = end


def _deal(u: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    x = u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ w.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _by_shard(shard: np.ndarray, n: int):
    order = np.argsort(shard.astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")
    cut = np.searchsorted(shard[order], np.arange(n + 1))
    return ((s, order[cut[s] : cut[s + 1]]) for s in range(n) if cut[s] < cut[s + 1])


def _named(names: np.ndarray, u: np.ndarray, w: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names that are used, in order, and u and w as places among them. place: room for a number for each name."""
    mark = np.zeros(len(names), bool)
    mark[u] = True
    mark[w] = True
    used = np.flatnonzero(mark)
    place[used] = np.arange(len(used))
    return names[used], place[u], place[w]


def _count_step(n: int):
    """Training counts of each chunk's distinct pairs; pairs that are only in held-out texts count 0."""

    def run(batches):
        for b in batches:
            held = b.column("held_out").to_numpy(zero_copy_only=False)
            for i, j in _chunks(b.column("text")):
                names, w, u, text = _tokens(b.column("text")[i:j].to_pylist())
                key = np.sort((w * len(names) + u) * 2 + held[i:j][text])  # of one pair, training tokens first
                pair = key >> 1
                first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                count = np.add.reduceat(1 - (key & 1), first)
                w, u = np.divmod(pair[first], len(names))
                del key, pair
                rows, place = [], np.zeros(len(names), np.int64)
                for s, own in _by_shard(_deal(names[u], names[w], n), n):
                    used, pu, pw = _named(names, u[own], w[own], place)
                    rows.append((TOKENS, s, 0, pack(used, True), pack(pw * len(used) + pu, True), pack(count[own])))
                yield from _messages(rows).to_batches()
            trim()

    return run


def _token_step(n: int):
    """For scoring: each chunk's distinct (text, pair) with how often; once per chunk the texts' ids."""

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            held = b.column("held_out").to_numpy(zero_copy_only=False)
            ids = b.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for i, j in _chunks(b.column("text")):
                names, w, u, text = _tokens(b.column("text")[i:j].to_pylist())
                chunk, seq = (task << 32) | seq, seq + 1
                rows = [(TEXTS, chunk % n, chunk, pack(ids[i:j].view(np.int64)), pack(held[i:j].astype(np.int64)), pack(null[i:j].astype(np.int64)), pack(np.bincount(text, minlength=j - i)))]
                size = len(names)
                if (j - i) * size * size < WIDE:
                    key = np.sort((w * size + u) * (j - i) + text)
                    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    times = np.diff(np.r_[first, len(key)])
                    rest, text = np.divmod(key[first], j - i)
                    w, u = np.divmod(rest, size)
                    del key, rest
                else:
                    order = np.lexsort((text, u, w))
                    u, w, text = u[order], w[order], text[order]
                    first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1]) | (text[1:] != text[:-1])])
                    times = np.diff(np.r_[first, len(u)])
                    u, w, text = u[first], w[first], text[first]
                place = np.zeros(size, np.int64)
                for s, own in _by_shard(_deal(names[u], names[w], n), n):
                    used, pu, pw = _named(names, u[own], w[own], place)
                    rows.append((TOKENS, s, chunk, pack(used, True), pack(pw * len(used) + pu, True), pack(text[own]), pack(times[own])))
                yield from _messages(rows).to_batches()
            trim()

    return run


def _word_tasks(n: int) -> int:
    """Words are far fewer than tokens, and each pair task writes to each word task."""
    return max(1, n // 4)


def _lines(shard: int, words: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray, t: np.ndarray, n: int) -> list[tuple]:
    """To each word task: its words here with customers and tables, as restaurant and as dish."""
    sums = [np.bincount(k, weights=v, minlength=len(words)).astype(np.int64) for k, v in ((u, c), (u, t), (w, c), (w, t))]
    return [(LINES, s, shard, pack(words[own], True), *(pack(x[own]) for x in sums)) for s, own in _by_shard(_deal(words, words, _word_tasks(n)), _word_tasks(n))]


def _rows(table: pa.Table, columns: tuple[str, ...], keep=None):
    """Rows of some columns, one at a time."""
    for k in range(table.num_rows) if keep is None else keep:
        yield [table.column(c)[k].as_py() for c in columns]


def _every(parts) -> np.ndarray:
    """The sorted union of sorted arrays; what is held grows with the union."""
    held, size = [np.zeros(0, np.int64)], 0
    for p in parts:
        held.append(p)
        size += len(p)
        if size > 4 * len(held[0]) + (1 << 18):
            held, size = [np.unique(np.concatenate(held))], 0
    return np.unique(np.concatenate(held))


def _start_step(n: int):
    """Adds up the counts of a shard's pairs; one table each. Also counts of counts."""

    def run(key, table):
        shard = key[0].as_py()
        words = _every(unpack(x.as_py(), True) for x in table.column("b0"))
        keys, counts = [], []
        for r in _rows(table, ("b0", "b1", "b2")):
            place = np.searchsorted(words, unpack(r[0], True))
            w, u = np.divmod(unpack(r[1], True), len(place))
            keys.append(place[w] * len(words) + place[u])
            counts.append(unpack(r[2]).astype(np.int32))
        key, c = np.concatenate(keys), np.concatenate(counts)
        del keys, counts
        order = np.argsort(key)
        key, c = key[order], c[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        w, u = np.divmod(key[first], len(words))
        c = np.add.reduceat(c, first).astype(np.int64)
        del key, order, first
        seen = c > 0
        u, w, c = u[seen], w[seen], c[seen]  # words of unseen pairs stay in `words`, so their lines ask for answers
        t = np.ones(len(c), np.int64)
        trim()
        rows = [(STATE, shard, 0, pack(words, True), pack(w * len(words) + u, True), pack(c), pack(t), pack(np.zeros(len(c), np.int64)))]
        rows.append((TOTAL, 0, 0, pack(np.array([(c == 1).sum(), (c == 2).sum()]))))
        return _messages(rows + _lines(shard, words, u, w, c, t, n))

    return run


def _stirling(d: float, size: int = STIRLING) -> np.ndarray:
    """log S_d(c, t) for c, t up to size."""
    table = np.full((size + 1, size + 1), -np.inf)
    table[0, 0] = 0.0
    for c in range(size):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            table[c + 1, t] = np.logaddexp(table[c, t - 1], np.log(np.maximum(c - t * d, 0)) + table[c, t])
    return table


def _lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def _saddle(log_ratio, d: float, steps: int = 48) -> np.ndarray:
    """log(1 - z) where z f'(z) / f(z) = c / t, with f(z) = (1 - (1 - z)^d) / d."""
    low, high = np.full(np.shape(log_ratio), -690.0), np.full(np.shape(log_ratio), -1e-12)
    for _ in range(steps):
        mid = (low + high) / 2
        up = np.log(-np.expm1(mid)) + np.log(d) + (d - 1) * mid - np.log(-np.expm1(d * mid)) > log_ratio
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def _contour(c: np.ndarray, t: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Scale of the parabola m (1 + iv)^2 that runs through the saddle point, and up to which v it counts."""
    y = np.maximum(np.exp(_saddle(np.log(c / t), d)), 1e-290)
    p = -c * np.log1p(-y)
    bend = c * np.maximum(1 + (1 - y) * (1 - d) / y - c / t, 1e-9)
    m = np.maximum(p, 2.0)
    return m, np.minimum(np.sqrt(1 + 45 / m), np.where(p >= 2, 9 * c / (2 * m * np.sqrt(bend)), np.inf))


def log_stirling(c: np.ndarray, t: np.ndarray, d: float, nodes: int = 48) -> np.ndarray:
    """log S_d(c, t) for large c, from c! / t! [z^c] f(z)^t. The coefficient is an integral over a parabola around the cut
    of f(exp(-p / c)) that runs through the saddle point, or over a circle where t is nearly c."""
    c, t = c.astype(np.float64), t.astype(np.float64)
    out, rest = np.zeros(len(c)), c - t
    at = np.flatnonzero(rest > 24)
    if len(at):
        cc, tt = c[at], t[at]
        m, reach = _contour(cc, tt, d)
        turn = 1 + 1j * reach[:, None] * ((np.arange(nodes) + 0.5) / nodes)
        q = m[:, None] * turn**2
        e = q + tt[:, None] * np.log((1 - (-np.expm1(-q / cc[:, None])) ** d) / d)
        top = e.real.max(1)
        whole = (np.exp(e - top[:, None]) * 2 * m[:, None] * turn).real.sum(1) * reach / (nodes * np.pi)
        out[at] = _lgamma(cc + 1) - _lgamma(tt + 1) - np.log(cc) + top + np.log(np.maximum(whole, 1e-300))
    at = np.flatnonzero((rest <= 24) & (rest > 0))
    if len(at):
        cc, tt, k = c[at], t[at], rest[at]
        z0 = np.maximum(-np.expm1(_saddle(np.log(cc / tt), d)), 1e-6)
        angle = (np.arange(128) + 0.5) * np.pi / 128
        z = z0[:, None] * np.exp(1j * angle)
        e = tt[:, None] * np.log((1 - (1 - z) ** d) / (d * z)) - 1j * k[:, None] * angle
        top = e.real.max(1)
        out[at] = _lgamma(cc + 1) - _lgamma(tt + 1) + top - k * np.log(z0) + np.log(np.maximum(np.exp(e - top[:, None]).real.sum(1) / 128, 1e-300))
    return out


def _draw_large(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, strength: float, rng, nodes: int = 64) -> np.ndarray:
    """Tables of dishes with many customers each: weights of values of t around the mode. All values of a dish share one
    contour, that of its mode."""
    rise = strength / d + others
    # The mode, where the derivative of the log weight in t = c / g is 0, as a root in y = log(1 - z).
    low, high = np.full(len(c), -690.0), np.full(len(c), -1e-12)
    for _ in range(48):
        mid = (low + high) / 2
        f = -np.expm1(d * mid) / d
        t = np.minimum(c * f / np.maximum(-np.expm1(mid) * np.exp((d - 1) * mid), 1e-300), c)
        up = np.log(d * (rise + t) * p) + np.log(f) - np.log(np.maximum(t, 1e-300)) > 0  # at this t more tables weigh more
        high, low = np.where(up, high, mid), np.where(up, mid, low)
    mode = np.clip(t, 1, c)
    limit = (rise + 1) * p / np.maximum(1 - p, 1e-9)  # mean of t - 1 for ever more customers
    limit = np.minimum(limit, 4 * mode + 64)  # far from that limit the mode counts
    wide = 9 * np.sqrt(np.maximum(limit / np.maximum(1 - p, 0.05), mode)) + 24
    first, last = np.maximum(1, np.floor(np.minimum(mode, 1 + limit) - wide)), np.minimum(c, np.floor(np.maximum(mode, 1 + limit) + wide))
    m, reach = _contour(c, np.minimum(mode, c - 1), d)
    turn = 1 + 1j * reach[:, None] * ((np.arange(nodes) + 0.5) / nodes)
    q = m[:, None] * turn**2
    log_f = np.log((1 - (-np.expm1(-q / c[:, None])) ** d) / d)
    scale = np.log(2 * m[:, None] * turn) + q
    log_f0 = np.log((1 - (-np.expm1(-m / c)) ** d) / d)
    turned = log_f - log_f0[:, None]
    rows = np.arange(len(c))
    for narrow in (True, False):  # the range whose weights count, then the draw
        size = np.ceil((last - first + 1) / GRID)
        start = first[:, None] + size[:, None] * np.arange(GRID)
        value = start + np.floor((size - 1) / 2)[:, None]
        e = scale + value[:, :1] * turned
        top = e.real.max(1)
        term, turn_by = np.exp(e - top[:, None]), np.exp(size[:, None] * turned)
        whole = np.empty(value.shape)
        for k in range(GRID):  # values of t are evenly spaced, so each term of the integral turns by a constant
            whole[:, k] = term.real.sum(1)
            term = term * turn_by
        weight = top[:, None] + value * log_f0[:, None] + np.log(np.maximum(whole, 1e-300)) - _lgamma(value + 1)
        if (near := np.flatnonzero(last + size > c - 24)).size:  # where t may be c, contours differ for each value
            value[near] = np.minimum(value[near], c[near, None])
            every = np.broadcast_to(c[near, None], value[near].shape)
            weight[near] = log_stirling(every.ravel(), value[near].ravel(), d).reshape(value[near].shape)
        weight += value * np.log(d * p)[:, None] + _lgamma(rise[:, None] + value) - _lgamma(rise)[:, None]
        fits = np.clip(last[:, None] - start + 1, 0, size[:, None])  # values in the cell
        weight = np.where(fits > 0, weight, -np.inf)
        best = weight.max(1, keepdims=True)
        if narrow:
            counts = weight > best - 30
            a, b = counts.argmax(1), GRID - 1 - counts[:, ::-1].argmax(1)
            first, last = np.maximum(first, start[rows, np.maximum(a - 1, 0)]), np.minimum(last, start[rows, b] + 2 * size - 1)
            continue
        chance = np.cumsum(np.exp(weight - best) * fits, 1)
        cell = np.minimum((chance < (rng.random(len(c)) * chance[:, -1])[:, None]).sum(1), GRID - 1)
        t = start[rows, cell] + np.floor(rng.random(len(c)) * np.maximum(fits[rows, cell], 1))
    return np.clip(t, 1, c).astype(np.int64)


def draw_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, strength: float, rng) -> np.ndarray:
    """Table counts of dishes with c customers each, given the tables of the restaurant's other dishes and the parent's
    probability."""
    t = np.minimum(c, 1)
    table = _stirling(d)
    few = np.flatnonzero((c > 1) & (c <= STIRLING))
    few = few[np.argsort(c[few], kind="stable")]
    cut = np.searchsorted(c[few], np.arange(STIRLING + 2))
    for size in range(2, STIRLING + 1):
        block = max(1, (1 << 20) // size)
        for k in range(cut[size], cut[size + 1], block):
            own = few[k : min(k + block, cut[size + 1])]
            steps = np.log(strength + d * (others[own][:, None] + np.arange(size))) + np.log(p[own])[:, None]
            weight = np.cumsum(steps, 1) + table[size, 1 : size + 1]
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            t[own] = 1 + (weight < (rng.random(len(own)) * weight[:, -1])[:, None]).sum(1)
    many = np.flatnonzero(c > STIRLING)
    for k in range(0, len(many), 256):
        own = many[k : k + 256]
        t[own] = _draw_large(c[own].astype(np.float64), others[own].astype(np.float64), p[own], d, strength, rng)
    return np.minimum(t, np.maximum(c, 0))


def strength_terms(customers: np.ndarray, tables: np.ndarray, d: float, strength: float, rng) -> tuple[float, float]:
    """Sums over restaurants of what the strength's Gamma conditional needs: tables opened by the strength, and -log x with
    x ~ Beta(strength + 1, customers - 1). Tables beyond the 4096th are opened by it so rarely that they count as Poisson."""
    some = customers > 1
    waits = float(-np.log(np.maximum(rng.beta(strength + 1, customers[some] - 1), 1e-300)).sum())
    left = np.sort(tables[tables > 1]) - 1
    opened, i = 0, 1
    while i <= 4096 and (alive := len(left) - int(np.searchsorted(left, i))):
        opened += int(rng.binomial(alive, strength / (strength + d * i)))
        i += 1
    far = left[left > 4096].astype(np.float64)
    opened += int(rng.poisson((strength / d * np.log((strength / d + far) / (strength / d + 4096))).sum())) if len(far) else 0
    return float(opened), waits


def _answers(rows: list[dict], words: np.ndarray, n: int, fields: tuple[str, ...]) -> list[np.ndarray]:
    """What the word tasks answered, in the order of words. Answers come in the order of the lines that asked."""
    found = {r["src"]: r for r in rows}
    out = [np.zeros(len(words), np.int64) for _ in fields]
    for s, own in _by_shard(_deal(words, words, _word_tasks(n)), _word_tasks(n)):
        for x, f in zip(out, fields):
            x[own] = unpack(found[s][f])
    return out


def _parent(c0: np.ndarray, t0: np.ndarray, m: dict) -> np.ndarray:
    return (c0 - m["d0"] * t0 + (m["a0"] + m["d0"] * m["T0"]) * m["base"]) / (m["a0"] + m["C0"])


def _word_step(m: dict, sweep: int, last: bool):
    """Adds up a word's lines, draws its tables in the parent (the first time: one) and answers every task that has the
    word. A word's tables are kept for the next sweep, where they do not count as those of other words."""

    def run(key, table):
        shard = key[0].as_py()
        rows = table.select(["kind", "src", "b0", "b1", "b2", "b3", "b4"]).to_pylist()
        lines, kept = [r for r in rows if r["kind"] == LINES], [r for r in rows if r["kind"] == WORDS]
        if not lines:
            return _messages([])
        parts = [(unpack(r["b0"], True), *(unpack(r[f"b{k}"]) for k in (1, 2, 3, 4))) for r in lines]
        words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        c_u, t_u, c_w, c0 = (np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=len(words)).astype(np.int64) for k in (1, 2, 3, 4))
        rng = np.random.default_rng([m["seed"], sweep, shard])
        t0 = np.minimum(c0, 1)
        if kept:  # the words are the same in every sweep
            others = np.maximum(m["T0"] - unpack(kept[0]["b1"]), 0.0)
            t0 = draw_tables(c0, others, np.full(len(c0), m["base"]), m["d0"], m["a0"], rng)
        opened, waits = strength_terms(c_u, t_u, m["d"], m["a"], rng) if sweep <= m["burn_in"] else (0.0, 0.0)
        sums = [c0.sum(), t0.sum(), c_w.sum(), (c_w > 0).sum(), (c_w == 1).sum(), (c_w == 2).sum(), opened, round(waits * 1024)]
        out = [(TOTAL, 0, 0, pack(np.array(sums, np.int64))), (WORDS, shard, 0, pack(words, True), pack(t0))]
        ends = np.cumsum([0, *(len(p[0]) for p in parts)])
        for r, a, b in zip(lines, ends, ends[1:]):
            own = at[a:b]
            out.append((ANSWER, r["src"], shard, *(pack(x[own]) for x in (t_u, c0, t0, *((c_u, c_w) if last else ())))))
        return _messages(out)

    return run


def _pair_step(m: dict, sweep: int, n: int):
    """Draws all tables of a shard's pairs; from sweep `burn_in` on, tables are summed up over the samples."""

    def run(key, table):
        shard, rows = key[0].as_py(), table.to_pylist()
        s = next(r for r in rows if r["kind"] == STATE)
        words = unpack(s["b0"], True)
        w, u = np.divmod(unpack(s["b1"], True), len(words))
        c, t, total = (unpack(s[f"b{k}"]) for k in (2, 3, 4))
        t_u, c0, t0 = _answers([r for r in rows if r["kind"] == ANSWER], words, n, ("b0", "b1", "b2"))
        p = _parent(c0, t0, m)
        rng = np.random.default_rng([m["seed"], 1000 + sweep, shard])
        t = draw_tables(c, np.maximum(t_u[u] - t, 0), p[w], m["d"], m["a"], rng)
        if sweep >= m["burn_in"]:
            total = total + t
        return _messages([(STATE, shard, 0, s["b0"], s["b1"], s["b2"], pack(t), pack(total))] + _lines(shard, words, u, w, c, t, n))

    return run


def _score_step(m: dict, n: int):
    """Sums of log probabilities of each chunk's texts over this shard's pairs."""

    def run(key, table):
        kind = table.column("kind").to_numpy()
        rows = table.filter(pa.array(kind != TOKENS)).to_pylist()
        out = [(TEXTS, 0, r["src"], r["b0"], r["b1"], r["b2"], r["b3"]) for r in rows if r["kind"] == TEXTS]
        state = next((r for r in rows if r["kind"] == STATE), None)
        if state is None:
            return _messages(out)
        words = unpack(state["b0"], True)
        key_, c, total = unpack(state["b1"], True), unpack(state["b2"]), unpack(state["b4"])  # pairs in order
        samples = []
        for k in range(m["samples"]):
            own, one = [r for r in rows if r["kind"] == ANSWER + 10 * (k + 1)], m["models"][k]
            if k == m["samples"] - 1:
                c_u, c_w = _answers(own, words, n, ("b3", "b4"))
            t_u, c0, t0 = _answers(own, words, n, ("b0", "b1", "b2"))
            samples.append((m["a"] + m["d"] * t_u, _parent(c0, t0, one)))
        known = c_w > 0
        base = np.log10((c_w + 0.1) / (m["N"] + 0.1 * (m["V"] + 1)))
        for src, *r in _rows(table, ("src", "b0", "b1", "b2", "b3"), np.flatnonzero(kind == TOKENS).tolist()):
            own = np.searchsorted(words, unpack(r[0], True))
            tw, tu = np.divmod(unpack(r[1], True), max(len(own), 1))
            tw, tu, text, times = own[tw], own[tu], unpack(r[2]), unpack(r[3])
            asked = tw * len(words) + tu
            at = np.minimum(np.searchsorted(key_, asked), max(len(key_) - 1, 0))
            hit = key_[at] == asked if len(key_) else np.zeros(len(tu), bool)
            seated = np.where(hit, c[at] - m["d"] * total[at] / m["samples"], 0.0) if len(key_) else np.zeros(len(tu))
            parent = sum(a[tu] * p[tw] for a, p in samples) / m["samples"]
            log = np.log10((seated + parent) / (m["a"] + c_u[tu]))
            last = int(text.max()) + 1 if len(text) else 0
            sums = [np.bincount(text, weights=x * times, minlength=last) for x in (log, base[tw], known[tw])]
            seen = np.flatnonzero(np.bincount(text, minlength=last))
            fixed = [np.rint(-x[seen] * FIXED).astype(np.int64) for x in sums[:2]]
            out.append((TOKENS, 0, src, pack(seen, True), *map(pack, fixed), pack(sums[2][seen].astype(np.int64))))
        trim()
        return _messages(out)

    return run


_RESULT_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _gather(key, table):
    rows = table.to_pylist()
    head = next(r for r in rows if r["kind"] == TEXTS)
    ids, held, null, size = (unpack(head[f"b{k}"]) for k in range(4))
    score, base, known = (np.zeros(len(ids), np.int64) for _ in range(3))
    for r in rows:
        if r["kind"] == TOKENS:
            at = unpack(r["b0"], True)
            for x, f in ((score, "b1"), (base, "b2"), (known, "b3")):
                x[at] += unpack(r[f])
    score, base = -score / FIXED, -base / FIXED
    return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(size), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})


class _Tables:
    """Message tables in the shared folder; the ones that are no longer read are dropped."""

    def __init__(self, spark):
        self.spark = spark

    def write(self, df: DataFrame) -> str:
        path = scratch_path(self.spark, "hpylm")
        df.write.partitionBy("kind").option("compression", "none").parquet(path)  # arrays are compressed already
        release_shuffles(self.spark)
        return path

    def read(self, path: str, kind: int, name: int | None = None, without: tuple[str, ...] = ()) -> DataFrame:
        rows = self.spark.read.schema(MESSAGE_SQL).parquet(path).where(F.col("kind") == kind).withColumn("kind", F.lit(kind if name is None else name))
        columns = [F.lit(None).cast("binary").alias(c) if c in without else F.col(c) for c in (x.split()[0] for x in MESSAGE_SQL.split(", "))]
        return rows.select(*columns)

    def drop(self, path: str, kind: int) -> None:
        drop_path(self.spark, f"{path}/kind={kind}")

    def totals(self, path: str) -> np.ndarray:
        """Sum of a step's totals: a row of a few numbers for each task."""
        rows = self.read(path, TOTAL).select("b0").collect()
        return sum((unpack(r.b0) for r in rows), np.zeros(1, np.int64))


def score(docs: DataFrame, folds: int = 10, burn_in: int = BURN_IN, samples: int = SAMPLES, strength: float = STRENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Texts whose id's crc32 is 0 modulo `folds`
    are held out."""
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    n = tasks_for(rows, SHARD_BYTES)
    disk = _Tables(spark)
    step = lambda df, f, sql=MESSAGE_SQL: df.groupBy("shard").applyInArrow(f, sql)
    rng = np.random.default_rng([seed, 77])

    pairs = disk.write(step(rows.select("text", "held_out").mapInArrow(_count_step(n), MESSAGE_SQL), _start_step(n)))
    once = disk.totals(pairs)
    discount = lambda one, two: float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95))
    m = {"a": strength, "a0": strength, "seed": seed, "burn_in": burn_in, "samples": samples, "d": discount(*once[:2]) if len(once) > 1 else 0.5, "d0": 0.5, "base": 1.0, "C0": 0.0, "T0": 0.0}
    models, answers, before = [], [], None
    for sweep in range(burn_in + samples + 1):
        asked = disk.read(pairs, LINES)
        if before is not None:
            asked = asked.union(disk.read(before, WORDS))
        path = disk.write(step(asked, _word_step(dict(m), sweep, sweep == burn_in + samples)))
        c0, t0, total, words, one, two, opened, waits = np.zeros(8) + disk.totals(path)
        disk.drop(pairs, LINES)
        if before is not None:
            disk.drop(before, WORDS)
        before = path
        m |= {"C0": float(c0), "T0": float(t0), "N": int(total), "V": int(words), "base": 1.0 / (int(words) + 1), "d0": discount(one, two)}
        if 0 < sweep <= burn_in:
            own, wait = strength_terms(np.array([int(c0)]), np.array([int(t0)]), m["d0"], m["a0"], rng)
            m |= {"a": float(max(rng.gamma(1 + opened, 1 / (1 + waits / 1024)), 1e-3)), "a0": float(max(rng.gamma(1 + own, 1 / (1 + wait)), 1e-3))}
        if sweep > burn_in:
            models.append(dict(m))
            answers.append(path)
        if sweep == burn_in + samples:
            break
        both = disk.read(pairs, STATE).union(disk.read(path, ANSWER))
        new = disk.write(step(both, _pair_step(dict(m), sweep, n)))
        drop_path(spark, pairs)
        pairs = new
        if sweep <= burn_in:
            disk.drop(path, ANSWER)
    m["models"] = models
    model = disk.read(pairs, STATE, without=("b3",))
    for k, path in enumerate(answers):
        model = model.union(disk.read(path, ANSWER, ANSWER + 10 * (k + 1)))
    found = None
    for part in range(PARTS):  # every text is in one part
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(PARTS)) == part).mapInArrow(_token_step(n), MESSAGE_SQL)
        sums = step(own.union(model), _score_step(m, n))
        done = materialise(sums.groupBy("src").applyInArrow(_gather, _RESULT_SQL), "hpylm-scores")
        del own, sums
        release_shuffles(spark)  # the part's tokens go before the next part's come
        found = done if found is None else found.union(done)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m["N"]).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame, column: str = "score") -> DataFrame:
    """held_out, perplexity, n_tokens: 10 to the mean negative log10 probability of a token, for each of the two parts; null
    ids count as training texts and an empty table gives no rows."""
    sums = scored.groupBy("held_out").agg(F.sum(column).alias("_s"), F.sum("n_tokens").alias("n_tokens"))
    return sums.select("held_out", F.pow(F.lit(10.0), -F.col("_s") / F.col("n_tokens")).alias("perplexity"), "n_tokens")
