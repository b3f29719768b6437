"""Quality scores by a generalised additive model with pairwise interactions.

Every whole text becomes a few numbers (``FEATURES``).  Each number falls into a
bin, each feature has a lookup table with a value per bin, and some pairs of
features have a table over both bins; the score is the logistic function of the
sum.  The tables are learned by cyclic gradient boosting: round after round, one
shallow tree per feature is fitted to what is left to explain and added to the
feature's table in small steps; then the pairs that explain most of the rest get
trees that cut both features.  Scoring a batch is one search for bins and one
addition per table.

Training happens on the driver with the numbers, not the texts, of at most about
``SAMPLE_ROWS`` labelled documents, chosen by the hash of their id.

Edge cases: null and empty texts have all numbers zero and a score like any
other; without labels every score is one half; labels that contradict each other
or repeat count as rows of their own; ids that repeat are scored row by row.
Other columns are not read and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runweave.llm.common import slices
from runweave.llm.hashing import word_hashes

SAMPLE_ROWS = 20_000
SLICE = 4 << 20
# Parameters of the model.
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 200
PAIR_ROUNDS = 60
RATE = 0.1
LEAVES = 4
RIDGE = 1.0
LEAST_ROWS = 5

FEATURES = [
    "log_chars",
    "log_words",
    "word_bytes",
    "upper_share",
    "digit_share",
    "symbol_share",
    "odd_symbol_share",
    "bang_per_word",
    "bar_per_word",
    "stop_per_word",
    "distinct_words",
    "repeat_of_last",
    "repeat_of_last_but_one",
    "commonest_word",
    "log_lines",
    "words_per_line",
    "distinct_lines",
    "space_share",
]

_kind = {}
_all = np.arange(256)
_kind["char"] = (_all < 0x80) | (_all >= 0xC0)
_kind["upper"] = (_all >= 65) & (_all <= 90)
_kind["letter"] = _kind["upper"] | ((_all >= 97) & (_all <= 122)) | (_all >= 0xC0)
_kind["digit"] = (_all >= 48) & (_all <= 57)
_kind["space"] = (_all == 32) | ((_all >= 9) & (_all <= 13))
_kind["symbol"] = (_all > 32) & (_all < 127) & ~_kind["letter"] & ~_kind["digit"]
_kind["odd"] = _kind["symbol"] & ~np.isin(_all, [ord(c) for c in ".,;:!?'\"()-"])
_kind["bang"] = _all == ord("!")
_kind["bar"] = _all == ord("|")
_kind["stop"] = _all == ord(".")
_kind["line"] = _all == 10


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    raw = b"\n".join(texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    count = {name: np.add.reduceat(table[data].astype(np.int64), starts) for name, table in _kind.items()}
    at, hashes = word_hashes(raw)
    bounds = np.searchsorted(at, np.append(starts, len(raw)))
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        own = hashes[bounds[i] : bounds[i + 1]]
        n = len(own)
        if not n:
            continue
        _, times = np.unique(own, return_counts=True)
        lines = text.split(b"\n")
        chars = count["char"][i] - 1
        letters = max(count["letter"][i], 1)
        out[i] = [
            np.log1p(chars),
            np.log1p(n),
            len(text) / n,
            count["upper"][i] / letters,
            count["digit"][i] / chars,
            count["symbol"][i] / chars,
            count["odd"][i] / chars,
            count["bang"][i] / n,
            count["bar"][i] / n,
            count["stop"][i] / n,
            len(times) / n,
            np.count_nonzero(own[1:] == own[:-1]) / n,
            np.count_nonzero(own[2:] == own[:-2]) / n,
            times.max() / n,
            np.log1p(len(lines)),
            n / len(lines),
            len(set(lines)) / len(lines),
            (count["space"][i] - 1) / chars,
        ]
    return out


@dataclass
class Model:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, numbers: np.ndarray) -> np.ndarray:
        total = np.full(len(numbers), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, numbers[:, f], side="right")]
        for a, b, table in self.pairs:
            row = np.searchsorted(self.pair_cuts[a], numbers[:, a], side="right")
            total += table[row, np.searchsorted(self.pair_cuts[b], numbers[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin borders at quantiles, without repeats."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g**2 / (h + RIDGE)


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The value per bin of a tree with at most ``LEAVES`` leaves over ordered
    bins with gradient, curvature and row sums."""
    leaves, value = [(0, len(g))], np.zeros(len(g))
    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for leaf in leaves:
            low, high = leaf
            cg, ch, cn = np.cumsum(g[low:high]), np.cumsum(h[low:high]), np.cumsum(n[low:high])
            gains = _gain(cg, ch) + _gain(cg[-1] - cg, ch[-1] - ch) - _gain(cg[-1], ch[-1])
            gains = np.where((cn >= LEAST_ROWS) & (cn[-1] - cn >= LEAST_ROWS), gains, 0)
            at = int(gains.argmax())
            if gains[at] > best[0]:
                best = (gains[at], leaf, low + at + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    for low, high in leaves:
        value[low:high] = g[low:high].sum() / (h[low:high].sum() + RIDGE)
    return value


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts a row feature once and a column
    feature once, over sums per pair of bins."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    def parts(c: np.ndarray) -> list[np.ndarray]:
        top, left, all_ = c[:, -1:], c[-1:, :], c[-1, -1]
        return [c, top - c, left - c, all_ - top - left + c]

    gains = sum(_gain(a, b) for a, b in zip(parts(cg), parts(ch))) - _gain(cg[-1, -1], ch[-1, -1])
    r, c = np.unravel_index(int(gains.argmax()), gains.shape)
    value = np.zeros_like(g)
    for rows in (slice(0, r + 1), slice(r + 1, None)):
        for cols in (slice(0, c + 1), slice(c + 1, None)):
            value[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return float(gains[r, c]), value


def train(numbers: np.ndarray, labels: np.ndarray) -> Model:
    """Boost the tables on labelled rows."""
    if not len(labels):
        return Model()
    rate = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    model = Model(base=float(np.log(rate / (1 - rate))))
    wide = range(numbers.shape[1])
    model.cuts = [_cuts(numbers[:, f], BINS) for f in wide]
    model.pair_cuts = [_cuts(numbers[:, f], PAIR_BINS) for f in wide]
    fine = [np.searchsorted(c, numbers[:, f], side="right") for f, c in enumerate(model.cuts)]
    coarse = [np.searchsorted(c, numbers[:, f], side="right") for f, c in enumerate(model.pair_cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(fine, model.tables)]
    total = np.full(len(labels), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            g, h = slope()
            step = RATE * shallow_tree(np.bincount(fine[f], g, len(table)), np.bincount(fine[f], h, len(table)), rows[f])
            table += step
            total += step[fine[f]]
    g, h = slope()
    shape = [len(c) + 1 for c in model.pair_cuts]

    def grids(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = coarse[a] * shape[b] + coarse[b]
        size = shape[a] * shape[b]
        return cell, np.bincount(cell, g, size).reshape(shape[a], shape[b]), np.bincount(cell, h, size).reshape(shape[a], shape[b])

    ranked = sorted(((cross_tree(*grids(a, b, g, h)[1:])[0], a, b) for a in wide for b in range(a + 1, len(wide))), reverse=True)
    model.pairs = [(a, b, np.zeros((shape[a], shape[b]))) for _, a, b in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            cell, gg, hh = grids(a, b, *slope())
            step = RATE * cross_tree(gg, hh)[1]
            table += step
            total += step.ravel()[cell]
    return model


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if (x := t.as_buffer()) is None else x.to_pybytes() for t in batch.column("text")]


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """Train on the rows of ``labels`` (``doc_id, quality``) where ``learn`` holds."""
    wanted = labels.where(learn & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    n = wanted.count()
    if not n:
        return Model()
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # The bound on the sample bounds what is broadcast.
    sample = wanted.where(rank < min(1.0, SAMPLE_ROWS / n)).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(2 * SAMPLE_ROWS)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            numbers = text_features(_raw(batch))
            columns = [pa.array(numbers[:, i]) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *columns], ["doc_id", "quality", *FEATURES])

    schema = "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES)
    # One text per id and label, however often an id repeats.
    found = texts.mapInArrow(run, schema).groupBy("doc_id", "quality").agg(*[F.min(f).alias(f) for f in FEATURES])
    rows = found.toPandas().sort_values(["doc_id", "quality"])
    return train(rows[FEATURES].to_numpy(), (rows["quality"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            scores = model.score(text_features(_raw(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
