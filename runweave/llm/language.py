"""Language identification by a linear-chain conditional random field.

A text is a sequence of words (runs of letters).  Every word gets a score per
language from hashed features: its affixes and inner n-grams of two to four
characters, the word itself, and which language a lexicon, counted from the
training words, gives it to.  Learned transition scores say how often text
switches language.  Forward-backward gives every word's marginals; a text's
language is the one with the largest mean marginal, which is the score.

Training is a bounded job on the driver: from at most about ``SAMPLE_DOCS``
documents (by hash of the id, evenly per language) tasks cut at most
``SEGMENTS`` stretches of ``SEGMENT_WORDS`` words each, spread over the whole
text, and stretches of different documents are joined to code-switched sequences
from which the transitions are learned.  Everything else runs in tasks, over
whole texts; words are scored once per batch.

Edge cases: null, empty and letterless texts are ``und`` with score 0; without
any labelled row every text is ``und``; a text of any length is one sequence;
ties go to the first language by name; rows that repeat are each labelled; the
input row is kept as a struct, so no name clashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from runweave.llm.common import row_texts, slices
from runweave.llm.hashing import U64, mix

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case words with a letter in them; superscripts, fractions, and Roman and
    circled numerals are none."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


# Parameters of the training sample.
SAMPLE_DOCS = 2_000
SEGMENTS = 4
SEGMENT_WORDS = 24
# Parameters of the model and of training.
BUCKETS = 1 << 17
JOINED = 3
EPOCHS = 4
SEQUENCES_A_STEP = 32
RATE = 0.3
DECAY = 1e-6
LEXICON_COUNT = 3
LEXICON_SHARE = 0.9
SLICE = 1 << 19


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature bucket x language
    transitions: np.ndarray  # from x to
    start: np.ndarray
    lexicon: dict[str, int]


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words in a row, and where each word's begin."""
    # The marks around a word make its first and last n-grams its affixes.
    marked = ["\x02" + w + "\x03" for w in words]
    sizes = np.array([len(w) for w in marked])
    flat = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(U64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    found, owners = [], []
    rolled = flat.copy()
    for n in (2, 3, 4):
        rolled = rolled[: len(flat) - n + 1] * U64(0x9E3779B97F4A7C15) + flat[n - 1 :]
        inside = owner[: len(rolled)] == owner[n - 1 :]
        found.append(mix(rolled[inside] + U64(n)))
        owners.append(owner[: len(rolled)][inside])
    powers = np.cumprod(np.full(len(flat) + 1, U64(0xD6E8FEB86659FD93), U64))
    local = np.arange(len(flat)) - starts[owner]
    whole = np.add.reduceat(flat * powers[local], starts)
    found.append(mix(whole))
    owners.append(np.arange(len(words)))
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if known:
        at, language = np.array(known).T
        found.append(mix(language.astype(U64) + U64(1 << 40)))
        owners.append(at)
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    firsts = np.searchsorted(owners[order], np.arange(len(words)))
    return (found[order] % U64(BUCKETS)).astype(np.int64), firsts


def emission_scores(words: list[str], model: Model) -> np.ndarray:
    buckets, firsts = word_features(words, model.lexicon)
    return np.add.reduceat(model.weights[buckets], firsts, axis=0).astype(np.float64)


class Packed:
    """Sequences of different lengths side by side, longest first, so that a
    step in time is one slice."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        longest = int(sizes[0]) if len(sizes) else 0
        self.active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        # Place in the flat input of every packed row.
        row = np.repeat(np.arange(longest), self.active)
        within = np.arange(self.at[-1]) - self.at[row]
        self.source = offsets[self.order][within] + row

    def steps(self) -> Iterator[tuple[int, int, int]]:
        for t, n in enumerate(self.active):
            yield t, int(self.at[t]), int(n)


def forward_backward(scores: np.ndarray, packed: Packed, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every packed word, and the expected number of transitions."""
    peak = scores.max(1, keepdims=True)
    emit = np.exp(scores - peak)
    step = np.exp(model.transitions - model.transitions.max())
    first = np.exp(model.start - model.start.max())
    alpha = np.empty_like(emit)
    scale = np.empty(len(emit))
    for t, at, n in packed.steps():
        if t == 0:
            here = emit[at : at + n] * first
        else:
            before = int(packed.at[t - 1])
            here = (alpha[before : before + n] @ step) * emit[at : at + n]
        total = here.sum(1)
        scale[at : at + n] = total
        alpha[at : at + n] = here / total[:, None]
    beta = np.ones_like(emit)
    moved = np.zeros_like(step)
    for t in range(len(packed.active) - 1, 0, -1):
        at, n, before = int(packed.at[t]), int(packed.active[t]), int(packed.at[t - 1])
        ahead = emit[at : at + n] * beta[at : at + n] / scale[at : at + n, None]
        beta[before : before + n] = ahead @ step.T
        moved += (alpha[before : before + n].T @ ahead) * step
    return alpha * beta, moved


def train(segments: list[tuple[list[str], int]], languages: list[str], seed: int = 7) -> Model:
    """Fit on stretches of words with their language, by AdaGrad on the
    conditional likelihood of code-switched sequences."""
    k = len(languages)
    counts: dict[str, np.ndarray] = {}
    for words, language in segments:
        for w in words:
            counts.setdefault(w, np.zeros(k))[language] += 1
    lexicon = {
        w: int(c.argmax()) for w, c in counts.items() if c.sum() >= LEXICON_COUNT and c.max() >= LEXICON_SHARE * c.sum()
    }
    model = Model(languages, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k), lexicon)
    names = sorted(counts)
    number = {w: i for i, w in enumerate(names)}
    buckets, firsts = word_features(names, lexicon)
    ends = np.append(firsts[1:], len(buckets))
    rng = np.random.default_rng(seed)
    squares = [np.full_like(model.weights, 1e-2), np.full_like(model.transitions, 1e-2), np.full_like(model.start, 1e-2)]
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(segments))
        # A third of the stretches stand alone, the rest follow one another.
        sequences = np.array_split(shuffled, max(1, len(shuffled) // JOINED))
        for low in range(0, len(sequences), SEQUENCES_A_STEP):
            chosen = sequences[low : low + SEQUENCES_A_STEP]
            words = np.array([number[w] for s in chosen for i in s for w in segments[i][0]])
            truth = np.array([segments[i][1] for s in chosen for i in s for _ in segments[i][0]])
            packed = Packed(np.array([sum(len(segments[i][0]) for i in s) for s in chosen]))
            words, truth = words[packed.source], truth[packed.source]
            used, place = np.unique(words, return_inverse=True)
            sizes = ends[used] - firsts[used]
            spots = np.repeat(firsts[used] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            active = buckets[spots]
            heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            scores = np.add.reduceat(model.weights[active], heads, axis=0).astype(np.float64)[place]
            marginal, moved = forward_backward(scores, packed, model)
            error = np.zeros_like(marginal)
            error[np.arange(len(truth)), truth] = 1
            n_first = int(packed.active[0])
            start_step = error[:n_first].sum(0) - marginal[:n_first].sum(0)
            seen = np.zeros_like(moved)
            for t in range(1, len(packed.active)):
                at, n, before = int(packed.at[t]), int(packed.active[t]), int(packed.at[t - 1])
                np.add.at(seen, (truth[before : before + n], truth[at : at + n]), 1)
            error -= marginal
            per_word = np.stack([np.bincount(place, error[:, c], len(used)) for c in range(k)], 1)
            spread = np.repeat(per_word, sizes, axis=0)
            step = np.stack([np.bincount(active, spread[:, c], BUCKETS) for c in range(k)], 1) / len(chosen)
            steps = [step - DECAY * model.weights, (seen - moved) / len(chosen), start_step / len(chosen)]
            for value, square, gradient in zip((model.weights, model.transitions, model.start), squares, steps):
                square += gradient**2
                value += RATE * gradient / np.sqrt(square)
    return model


def predict(texts: list[str], model: Model) -> tuple[list[str], list[float]]:
    """Language and score of every text."""
    split = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in split])
    label, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    some = np.flatnonzero(lengths)
    if not len(some) or not model.languages:
        return label, score
    names: dict[str, int] = {}
    codes = np.array([names.setdefault(w, len(names)) for words in split for w in words], np.int64)
    scores = emission_scores(list(names), model)
    packed = Packed(lengths[some])
    marginal, _ = forward_backward(scores[codes[packed.source]], packed, model)
    flat = np.empty_like(marginal)
    flat[packed.source] = marginal
    sums = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(lengths[some])[:-1]]), axis=0)
    shares = sums / sums.sum(1, keepdims=True)
    for i, share in zip(some.tolist(), shares):
        best = int(share.argmax())
        label[i], score[i] = model.languages[best], min(1.0, float(share[best]))
    return label, score


def word_languages(text: str, model: Model) -> list[tuple[str, str]]:
    """Every word of a text with its own most likely language."""
    words = words_of(text)
    if not words or not model.languages:
        return [(w, UNKNOWN) for w in words]
    packed = Packed(np.array([len(words)]))
    marginal, _ = forward_backward(emission_scores(words, model)[packed.source], packed, model)
    return [(w, model.languages[int(m.argmax())]) for w, m in zip(words, marginal)]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def fit(docs: DataFrame, learn: Column) -> Model:
    """Train on ``docs`` (``doc_id, text, lang``) where ``learn`` holds."""
    rows = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0), {})
    # Evenly per language, by the hash of the id.
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col("lang") == language, F.lit(min(1.0, SAMPLE_DOCS / len(languages) / n))).otherwise(share)
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, out = [], [], []
            for doc, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), _texts(batch)):
                words = words_of(text)
                pieces = min(SEGMENTS, -(-len(words) // SEGMENT_WORDS))
                for i in range(pieces):
                    at = i * max(len(words) - SEGMENT_WORDS, 0) // max(pieces - 1, 1)
                    ids.append(doc)
                    langs.append(lang)
                    out.append(" ".join(words[at : at + SEGMENT_WORDS]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.string())], ["doc_id", "lang", "words"]
            )

    chosen = rows.where(rank < share).withColumn("doc_id", F.col("doc_id").cast("long"))
    # Rows of one id may repeat without end: keep as many as the sample has.
    cuts = chosen.mapInArrow(cut, "doc_id long, lang string, words string").distinct()
    cuts = cuts.orderBy(F.xxhash64("doc_id", "words")).limit(2 * SAMPLE_DOCS * SEGMENTS).collect()
    number = {language: i for i, language in enumerate(languages)}
    segments = sorted((r["doc_id"], r["words"], number[r["lang"]]) for r in cuts)
    return train([(w.split(" "), y) for _, w, y in segments], languages)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (the input row), ``lang_pred`` and ``lang_score``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(row_texts(batches), "text", SLICE):
            label, score = predict(_texts(batch), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(label, pa.string()), pa.array(score, pa.float64())],
                ["row", "lang_pred", "lang_score"],
            )

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def id_remainder(n: int, col: str = "doc_id") -> Column:
    """CRC-32 of an id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.encode(F.col(col).cast("string"), "UTF-8")) % n


def drop_unknown(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text has a language, as they are."""
    return identify(docs, model).where(F.col("lang_pred") != UNKNOWN).select("row.*")
