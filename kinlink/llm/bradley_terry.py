"""Quality scores from pairwise preferences (Bradley-Terry).

P(a is preferred to b) = sigmoid(w . (f(a) - f(b))) with text features f. Every pair of a good and a bad labelled
document is a preference; w minimises the mean logistic loss of the feature differences of all these pairs. A document's
strength is w . f; the strength at the quantile that equals the share of bad labels is the decision threshold, and the
score is the logistic function of the strength, placed so that the threshold scores `cut`.

All labelled documents count, and no pair is made: what the loss needs of the pairs of a document depends on its strength
and on how the other class's strengths are spread, so a Newton step is two passes over a table of feature rows, one for
the spread of strengths in narrow bins and one for slope and curvature. The threshold is an exact order statistic. Tasks
send sums only. Features are read from the text alone.

Defined results: null text is empty and scored like any text; null or conflicting labels of a document count as the
largest one given, null ones are no label; without both classes among the labels every score is 0.5; rows with a null
doc_id are scored and counted as not held out; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import materialise, sliced, text_table, trim

#: Preference pairs drawn by `fit`, and ids of labelled documents that are sent to all tasks at most.
PAIRS, BROADCAST_IDS = 60_000, 1_000_000
#: Bins of strengths of one class, the strength at their ends, and coarser bins for the curvature's mixed term.
BINS, REACH, COARSE = 4096, 64.0, 256
#: Marks whose shares are features.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str) -> np.ndarray:
    """Shares of byte classes, of each punctuation mark, of repeated and oddly shaped words, lengths and entropy."""
    raw = text.encode("utf-8")
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    share = hist / max(n, 1)
    words = raw.split()
    m = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x]
    p = share[share > 0]
    marks = share[list(_MARKS)]
    odd = sum(not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,;:") for w in words) / m
    inner = sum(len(w) > 1 and w[-2:-1] == w[-1:] and not w[-1:].isalnum() and w[-1] < 128 for w in words) / m
    return np.concatenate(
        [
            np.log1p(100 * marks),
            [
                math.log1p(n),
                math.log1p(len(words)),
                share[65:91].sum(),
                share[97:123].sum(),
                share[48:58].sum(),
                share[128:].sum(),
                share[[9, 10, 11, 12, 13, 32]].sum(),
                len(set(words)) / m,
                sum(map(bytes.__eq__, words, words[1:])) / m,
                odd,
                inner,
                sum(w.isupper() for w in words) / m,
                sum(len(w) == 1 for w in words) / m,
                min(n / m, 40) / 10,
                -float((p * np.log(p)).sum()),
                len(set(lines)) / max(len(lines), 1),
                math.log1p(len(words) / max(len(lines), 1)),
                float(n == 0),
            ],
        ]
    )


def _fold(column, of: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(of))


def fit(good: np.ndarray, bad: np.ndarray, cut: float, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> dict:
    """Newton steps on the mean logistic loss of differences of good and bad feature rows at hand, over drawn pairs and with
    a ridge. `fitted` takes all pairs of a table."""
    width = features("").size
    if not len(good) or not len(bad):
        return {"mean": np.zeros(width), "w": np.zeros(width), "at": 0.0, "cut": 0.5}
    every = np.concatenate([good, bad])
    mean, scale = every.mean(0), every.std(0)
    scale[scale < 1e-9] = np.inf
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(good), pairs), rng.integers(0, len(bad), pairs)
    x = ((good[a] - bad[b]) / scale).astype(np.float64)
    w = np.zeros(width)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - 1) / pairs + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / pairs + ridge * np.eye(width)
        step = np.linalg.solve(curve, slope)
        w -= step
        if abs(step).max() < 1e-6:
            break
    strength = ((every - mean) / scale) @ w
    return {"mean": mean, "w": w / scale, "at": float(np.quantile(strength, len(bad) / len(every))), "cut": cut}


def labelled(docs: DataFrame, labels: DataFrame, keep) -> DataFrame:
    """doc_id, quality, f (the feature row's bytes) of the labelled documents: one row for each id, that of the smallest text
    hash."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(keep)
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality"))

    def run(batches):
        for b in sliced(batches):
            texts = b.column("text").to_pylist()
            rows, mark = [features(x).tobytes() for x in texts], [xxhash.xxh64_intdigest(x.encode("utf-8")) >> 1 for x in texts]
            yield pa.record_batch([b.column("doc_id"), b.column("quality"), pa.array(mark, pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "quality", "mark", "f"])
        trim()

    few = marked.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    dealt = text_table(docs).join(F.broadcast(marked) if few else marked, "doc_id").select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, mark long, f binary")
    one = dealt.groupBy("doc_id").agg(F.min(F.struct("mark", "quality", "f")).alias("x"))  # a row for each id, however often it occurs
    return one.select("doc_id", "x.quality", "x.f").sortWithinPartitions("doc_id")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def labelled_features(docs: DataFrame, labels: DataFrame, keep) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all good and bad documents, for tables that are small."""
    found = labelled(docs, labels, keep).orderBy("doc_id").toArrow()
    y = found.column("quality").to_numpy()
    f = _matrix(found.column("f")) if len(y) else np.zeros((0, features("").size))
    return f[y == 1], f[y != 1]


def _parts(rows: DataFrame, step) -> list[np.ndarray]:
    """step(feature rows, whether they are good) -> float64 array, of each slice of the table; sums by task."""

    def run(batches):
        total = None
        for b in sliced(batches, 4096):
            if b.num_rows:
                part = step(_matrix(b.column("f")), b.column("quality").to_numpy() == 1)
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return [np.frombuffer(x, np.float64) for x in rows.mapInArrow(run, "part binary").toArrow().column("part").to_pylist()]


def _order_statistics(rows: DataFrame, strength, ranks: list[int], few: int = 2000) -> list[float]:
    """The strengths of these ranks (from 0). An interval around a rank shrinks until few distinct strengths are left in it;
    what is left is counted by value."""

    def held(lo: float, hi: float, edges) -> tuple[int, np.ndarray, np.ndarray]:
        """Rows under lo, and strengths from lo to hi by bin or, without bins, by value."""

        def run(batches):
            for b in sliced(batches, 4096):
                s = strength(_matrix(b.column("f"))) if b.num_rows else np.zeros(0)
                inside = s[(s >= lo) & (s <= hi)]
                if edges is None:
                    v, n = np.unique(inside, return_counts=True)
                else:
                    v, n = np.unique(np.searchsorted(edges, inside, "right"), return_counts=True)
                yield pa.record_batch([pa.array(np.r_[-np.inf, v]), pa.array(np.r_[(s < lo).sum(), n].astype(np.int64))], names=["v", "n"])

        got = rows.mapInArrow(run, "v double, n long").groupBy("v").agg(F.sum("n").alias("n")).orderBy("v").toArrow()
        v, n = got.column("v").to_numpy(), got.column("n").to_numpy()
        return int(n[0]), v[1:], n[1:]

    out, known = [], {}
    wide = np.sinh(np.linspace(-40, 40, BINS + 1))  # finer bins where strengths are
    for rank in ranks:
        lo, hi, edges = wide[0], wide[-1], wide
        while True:
            key = (lo, hi, edges is None)
            if key not in known:
                known[key] = held(lo, hi, edges)
            under, v, n = known[key]
            k = min(int(np.searchsorted(np.cumsum(n), rank - under, "right")), len(v) - 1)
            if edges is None:
                out.append(float(v[k]))
                break
            at = int(v[k])
            lo, hi = float(edges[at - 1]), float(edges[min(at, BINS)])
            edges = np.linspace(lo, hi, BINS + 1) if n[k] > few and lo < lo + (hi - lo) / BINS < hi else None
    return out


def fitted(docs: DataFrame, labels: DataFrame, keep, cut: float, ridge: float = 1e-3) -> dict:
    """The model of all labelled documents and all pairs of a good and a bad one."""
    return fit_table(materialise(labelled(docs, labels, keep), "preferences"), cut, ridge)


def fit_table(rows: DataFrame, cut: float, ridge: float = 1e-3) -> dict:
    """As `fitted`, of a table with columns quality and f."""
    width = features("").size

    def sums(f, good):
        return np.concatenate([[good.sum(), (~good).sum()], f.sum(0)])

    total = sum(_parts(rows, sums), np.zeros(width + 2))
    goods, bads = total[:2]
    if not goods or not bads:
        return {"mean": np.zeros(width), "w": np.zeros(width), "at": 0.0, "cut": 0.5}
    mean = total[2:] / (goods + bads)
    scale = np.sqrt(sum(_parts(rows, lambda f, good: ((f - mean) ** 2).sum(0))) / (goods + bads))
    scale[scale < 1e-9] = np.inf
    grid, w = np.linspace(-REACH, REACH, BINS + 1), np.zeros(width)
    for _ in range(25):

        def spread(f, good, w=w):
            s = np.clip(((f - mean) / scale) @ w, -REACH, REACH)
            at = np.minimum(((s + REACH) * (BINS / (2 * REACH))).astype(np.int64), BINS - 1)
            return np.concatenate([np.bincount(at[k], weights, BINS) for k in (good, ~good) for weights in (None, s[k])])

        n, s = sum(_parts(rows, spread)).reshape(2, 2, BINS).swapaxes(0, 1)
        # By strength: the mean over the other class of 1 - p and of p (1 - p), at the grid's points.
        miss, curve = [], []
        for side, other in ((1, 1), (-1, 0)):
            used = n[other] > 0
            at, share = s[other][used] / n[other][used], n[other][used] / n[other].sum()
            q = 1 / (1 + np.exp(np.clip(side * (grid[:, None] - at[None, :]), -60, 60)))
            miss.append(q @ share)
            curve.append((q * (1 - q)) @ share)

        def moments(f, good, w=w, miss=miss, curve=curve):
            z = (f - mean) / scale
            s = np.clip(z @ w, -REACH, REACH)
            at = np.minimum(((s + REACH) * (COARSE / (2 * REACH))).astype(np.int64), COARSE - 1)
            slope, bend, binned = np.zeros(width), np.zeros((width, width)), np.zeros((2, COARSE, width + 2))
            for k, (own, of) in enumerate(((good, goods), (~good, bads))):
                slope += np.interp(s[own], grid, miss[k]) @ z[own] * ((-1, 1)[k] / of)
                bend += (z[own] * np.interp(s[own], grid, curve[k])[:, None]).T @ z[own] / of
                np.add.at(binned[k], at[own], np.concatenate([z[own], np.ones((own.sum(), 1)), s[own, None]], axis=1))
            return np.concatenate([slope, bend.ravel(), binned.ravel()])

        slope, bend, binned = np.split(sum(_parts(rows, moments)), [width, width + width * width])
        binned, bend = binned.reshape(2, COARSE, width + 2), bend.reshape(width, width)
        (fg, sg), (fb, sb) = ((x[used][:, :width], x[used][:, -1] / x[used][:, -2]) for x in binned for used in [x[:, -2] > 0])
        p = 1 / (1 + np.exp(np.clip(sb[None, :] - sg[:, None], -60, 60)))
        mixed = fg.T @ (p * (1 - p)) @ fb / (goods * bads)
        move = np.linalg.solve(bend - mixed - mixed.T + ridge * np.eye(width), slope + ridge * w)
        w = w - move
        if abs(move).max() < 1e-6:
            break

    def strength(f):
        return ((f - mean) / scale) @ w

    place = bads / (goods + bads) * (goods + bads - 1)
    below, above = _order_statistics(rows, strength, [math.floor(place), math.ceil(place)])
    return {"mean": mean, "w": w / scale, "at": below + (above - below) * (place - math.floor(place)), "cut": cut}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1)."""
    mean, w, at, shift = model["mean"], model["w"], model["at"], math.log(model["cut"] / (1 - model["cut"]))

    def run(batches):
        for b in sliced(batches):
            z = np.array([float((features(x) - mean) @ w) for x in b.column("text").to_pylist()])
            yield pa.record_batch([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z - at + shift, -40, 40))), pa.float64())], names=["doc_id", "score"])
        trim()

    return text_table(docs).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """Rows of docs whose score reaches the cut, with all their columns."""
    mean, w, at, shift, cut = model["mean"], model["w"], model["at"], math.log(model["cut"] / (1 - model["cut"])), model["cut"]

    def run(batches):
        for b in sliced(batches):
            z = np.array([float((features(x or "") - mean) @ w) for x in b.column("text").to_pylist()])
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(z - at + shift, -40, 40))) >= cut))
        trim()

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels count only outside the held-out fold (crc32 of the id's text)."""
    model = fitted(docs, labels, _fold("doc_id", folds) != 0, cut)
    held = F.coalesce(_fold("doc_id", folds) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
