"""SentencePiece encoding and decoding with the N best segmentations.

A text is a lattice: an edge for every piece of the vocabulary that matches, with
the piece's score, and one for every character without a piece, which becomes
its UTF-8 bytes.  A segmentation is a path; the best has the greatest sum of
scores.  Forward Viterbi gives every position the score of its best prefix.
That is an exact heuristic for an A-star search backward from the end: what it
completes first is best, what it completes next is second best, and so on.

No piece crosses from a word into the space before the next (checked when the
vocabulary is loaded), so the lattice of a text is a chain of word lattices.
Forward Viterbi runs once for all distinct words of a batch at the same time.
The N best of a text deviate from the best only in the N-1 words whose second
best is closest, so the backward search runs for those and its lists are merged.

The vocabulary file stays where it is; its path is a parameter read on the
driver, and its pieces (a fixed number) go to the tasks.

Edge cases: null and empty texts have no pieces and one segmentation; spaces,
control characters and the space mark itself survive the round trip; ties go to
the longer last piece in the best segmentation; a very long run without spaces
is one lattice, solved on its own, with memory for one number per character and
for the paths searched; rows that repeat are each encoded; the input
row is kept as a struct, so no name clashes.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from runweave.llm.common import row_texts, slices
from runweave.llm.hashing import U64, mix

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SLICE = 1 << 19
# Pieces decoded in one go.
PIECES_AT_ONCE = 1 << 19
N_BEST = 3
# Words of more characters are solved one by one.
LONG_WORD = 64
# So many solved words a task keeps in mind.
WORDS_KEPT = 50_000
# So many words are solved side by side.
WORDS_AT_ONCE = 1 << 15
# Bits of a hash that tell early that a substring is no piece.
FILTER_BITS = 20
UNKNOWN_PENALTY = 10.0
# Scores are kept to this part of one, so that sums are exact and equal sums are ties.
SCORE_UNIT = 1 / 65_536
WORD = re.compile(r"^[^ ]+| +[^ ]*")


@dataclass
class Vocabulary:
    """Pieces (spaces in place of the mark), their scores and ids."""

    ids: dict[str, int]
    scores: np.ndarray
    spelled: list[bytes]
    first_byte: int
    unknown: float
    longest: int
    values: list[float] = field(default_factory=list)
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    seen: np.ndarray = field(default_factory=lambda: np.zeros(1 << FILTER_BITS, bool))

    def __post_init__(self) -> None:
        self.values = self.scores.tolist()
        for n in range(1, self.longest + 1):
            known = [(p, i) for p, i in self.ids.items() if len(p) == n]
            codes = np.array([[ord(c) for c in p] for p, _ in known], U64).reshape(-1, n)
            keys = substring_hashes(codes)
            order = np.argsort(keys)
            self.seen[keys >> U64(64 - FILTER_BITS)] = True
            self.tables.append((keys[order], np.array([i for _, i in known], np.int64)[order]))


def substring_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash per row of character codes."""
    total = np.zeros(len(codes), U64)
    for i in range(codes.shape[1]):
        total = total * U64(0x9E3779B97F4A7C15) + codes[:, i]
    return mix(total)


def load(path: str = MODEL_PATH) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    scores = np.round(np.array([model.get_score(i) for i in range(size)]) / SCORE_UNIT) * SCORE_UNIT
    ids, spelled, first_byte = {}, [], -1
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            first_byte = i if value == 0 else first_byte
            spelled.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            text = piece.replace(MARK, " ")
            if re.search(r"[^ ] ", text):
                raise ValueError(f"piece {piece!r} goes beyond a word")
            ids[text] = i
            spelled.append(text.encode())
    if first_byte < 0:
        raise ValueError("the vocabulary has no bytes to fall back to")
    return Vocabulary(ids, scores, spelled, first_byte, float(scores.min()) - UNKNOWN_PENALTY, max(map(len, ids)))


def edges_into(word: str, end: int, vocabulary: Vocabulary) -> Iterator[tuple[int, float, int]]:
    """``start, score, id`` of the edges that end at a position, longest first; id
    -1 stands for the character's bytes."""
    found = False
    known, values = vocabulary.ids, vocabulary.values
    for start in range(max(0, end - vocabulary.longest), end):
        piece = known.get(word[start:end])
        if piece is not None:
            found = found or start == end - 1
            yield start, values[piece], piece
    if not found:
        yield end - 1, vocabulary.unknown, -1


def spell(word: str, path: list[tuple[int, int, int]], vocabulary: Vocabulary) -> list[int]:
    ids = []
    for start, end, piece in path:
        ids += [piece] if piece >= 0 else [vocabulary.first_byte + b for b in word[start:end].encode()]
    return ids


def n_best(word: str, n: int, vocabulary: Vocabulary) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of one lattice, best first.

    The agenda holds, for every suffix reached, only the best edge not yet taken;
    taking it puts the next one there.  Edges are looked up again instead of kept,
    so memory grows with the paths searched, not with the lattice.  Among ties the
    one nearest the start comes first: the search goes on to the start of a tied
    path before it turns to others.
    """
    best = array("d", [0.0])
    for end in range(1, len(word) + 1):
        best.append(max(best[start] + score for start, score, _ in edges_into(word, end, vocabulary)))
    agenda: list[tuple] = []
    tick = 0

    def offer(at: int, suffix: float, path: tuple, rank: int) -> None:
        """Put the edge of this rank among those into ``at`` on the agenda."""
        nonlocal tick
        edges = sorted((-(score + best[start]), start, score, piece) for start, score, piece in edges_into(word, at, vocabulary))
        if rank < len(edges):
            worth, start, score, piece = edges[rank]
            tick += 1
            heapq.heappush(agenda, (worth - suffix, start, tick, score, piece, at, suffix, path, rank))

    if not word:
        return [(0.0, [])]
    found = []
    offer(len(word), 0.0, (), 0)
    while agenda and len(found) < n:
        # What is known of the suffix plus the best of the prefix.
        _, start, _, score, piece, at, suffix, path, rank = heapq.heappop(agenda)
        offer(at, suffix, path, rank + 1)
        longer = ((start, at, piece), path)
        if start:
            offer(start, suffix + score, longer, 0)
            continue
        ids, steps = [], longer
        while steps:
            edge, steps = steps
            ids.append(edge)
        found.append((suffix + score, spell(word, ids, vocabulary)))
    return found


@dataclass
class Words:
    """Best segmentations of distinct words: all ids, where each word's begin and
    how many they are, and how much worse the second best is."""

    ids: np.ndarray
    firsts: np.ndarray
    sizes: np.ndarray
    scores: np.ndarray
    margins: np.ndarray


def solve(words: list[str], vocabulary: Vocabulary) -> Words:
    """Forward Viterbi over many words at once, and the best path of each."""
    count = len(words)
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-sizes, kind="stable")
    out = Words(np.zeros(0, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count), np.full(count, np.inf))
    n_long = int(np.count_nonzero(sizes > LONG_WORD))
    more, at = [], 0
    for low in range(n_long, count, WORDS_AT_ONCE):
        some = order[low : low + WORDS_AT_ONCE]
        more.append(_solve_short([words[w] for w in some.tolist()], sizes[some], some, out, vocabulary))
        out.firsts[some] += at
        at += len(more[-1])
    for w in order[:n_long].tolist():
        found = n_best(words[w], 2, vocabulary)
        more.append(np.array(found[0][1], np.int64))
        out.firsts[w], out.sizes[w], out.scores[w] = at, len(found[0][1]), found[0][0]
        at += len(found[0][1])
        if len(found) > 1:
            out.margins[w] = found[0][0] - found[1][0]
    out.ids = np.concatenate(more) if more else out.ids
    return out


def _short_edges(codes: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Words and pieces of the edges by (end, length); -1 for a character's bytes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    local = np.arange(len(codes)) - firsts[owner]
    left = sizes[owner] - local
    rolled = np.zeros(len(codes), U64)
    spots = np.arange(len(codes))
    edges = {}
    for n in range(1, vocabulary.longest + 1):
        spots = spots[left[spots] >= n]
        if not len(spots):
            break
        rolled[spots] = rolled[spots] * U64(0x9E3779B97F4A7C15) + codes[spots + n - 1]
        keys, known = vocabulary.tables[n - 1]
        if not len(keys):
            continue
        wanted = mix(rolled[spots])
        piece = np.full(len(spots), -1, np.int64)
        maybe = np.flatnonzero(vocabulary.seen[wanted >> U64(64 - FILTER_BITS)])
        at = np.minimum(np.searchsorted(keys, wanted[maybe]), len(keys) - 1)
        hit = keys[at] == wanted[maybe]
        piece[maybe[hit]] = known[at[hit]]
        mine = spots
        if n > 1:
            mine, piece = spots[piece >= 0], piece[piece >= 0]
        end = local[mine] + n
        by_end = np.argsort(end, kind="stable")
        mine, piece, end = owner[mine][by_end], piece[by_end], end[by_end]
        cuts = np.searchsorted(end, np.arange(int(sizes[0]) + 2))
        for e in range(1, int(sizes[0]) + 1):
            if cuts[e] < cuts[e + 1]:
                edges[e, n] = mine[cuts[e] : cuts[e + 1]], piece[cuts[e] : cuts[e + 1]]
    return edges


def _solve_short(words: list[str], sizes: np.ndarray, numbers: np.ndarray, out: Words, vocabulary: Vocabulary) -> np.ndarray:
    """The ids of ``words``, which are sorted by falling size; all else goes to
    their ``numbers`` in ``out``."""
    longest, count = int(sizes[0]), len(words)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(U64)
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    edges = _short_edges(codes, sizes, vocabulary)
    value = np.append(vocabulary.scores, vocabulary.unknown)
    best = np.full((longest + 1, count), -np.inf)
    second = np.full((longest + 1, count), -np.inf)
    length = np.zeros((longest + 1, count), np.int8)
    piece = np.zeros((longest + 1, count), np.int32)
    best[0] = 0
    for end in range(1, longest + 1):
        top, next_top = best[end], second[end]
        for n in range(min(end, vocabulary.longest), 0, -1):
            if (end, n) not in edges:
                continue
            w, ids = edges[end, n]
            here = best[end - n, w] + value[ids]
            was = top[w]
            wins = here > was
            next_top[w] = np.where(wins, was, np.maximum(next_top[w], here))
            w, ids = w[wins], ids[wins]
            top[w] = here[wins]
            length[end, w] = n
            piece[end, w] = ids
    # Walk back along the best paths.
    at = sizes.copy()
    margin = np.full(count, np.inf)
    steps = []
    walking = np.arange(count)
    while len(walking):
        end = at[walking]
        margin[walking] = np.minimum(margin[walking], best[end, walking] - second[end, walking])
        start = end - length[end, walking]
        steps.append((walking, start, piece[end, walking]))
        at[walking] = start
        walking = walking[start > 0]
    owner, start, found = (np.concatenate([s[i] for s in steps]) for i in range(3))
    line = np.argsort(owner * (longest + 1) + start)
    owner, start, found = owner[line], start[line], found[line]
    spread = np.ones(len(found), np.int64)
    missing = np.flatnonzero(found < 0)
    spelled = [chr(int(codes[firsts[owner[i]] + start[i]])).encode() for i in missing]
    spread[missing] = [len(x) for x in spelled]
    ids = np.repeat(found, spread)
    ends = np.cumsum(spread)
    for i, raw in zip(missing.tolist(), spelled):
        ids[ends[i] - len(raw) : ends[i]] = [vocabulary.first_byte + b for b in raw]
    total = np.bincount(owner, spread, count).astype(np.int64)
    out.firsts[numbers] = np.cumsum(total) - total
    out.sizes[numbers] = total
    out.scores[numbers] = best[sizes, np.arange(count)]
    out.margins[numbers] = margin
    return ids


class Memory:
    """The solved words of a task, so that a word is solved once; forgotten
    together when there are more than ``WORDS_KEPT``."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.others: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.known = Words(*(np.zeros(0, t) for t in (np.int32, np.int64, np.int64, float, float)))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of every word, solving those not seen before."""
        names: dict[str, int] = {}
        codes = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
        new = [w for w in names if w not in self.number]
        if len(self.names) + len(new) > WORDS_KEPT:
            self._forget()
            new = list(names)
        if new:
            found, known = solve(new, self.vocabulary), self.known
            self.number.update(zip(new, range(len(self.names), len(self.names) + len(new))))
            self.names += new
            self.known = Words(
                np.concatenate([known.ids, found.ids.astype(np.int32)]),
                np.concatenate([known.firsts, found.firsts + len(known.ids)]),
                np.concatenate([known.sizes, found.sizes]),
                np.concatenate([known.scores, found.scores]),
                np.concatenate([known.margins, found.margins]),
            )
        return np.array([self.number[w] for w in names], np.int64)[codes]

    def n_best(self, number: int, n: int) -> list[tuple[float, list[int]]]:
        word = self.names[number]
        if (word, n) not in self.others:
            if len(self.others) >= WORDS_KEPT // 4:
                self.others.clear()
            self.others[word, n] = n_best(word, n, self.vocabulary)
        return self.others[word, n]


def k_least_sums(lists: list[list[float]], k: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``k`` least sums with one entry of each rising list, and the entries."""
    sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for costs in lists:
        merged = [(s + c, chosen + (i,)) for s, chosen in sums for i, c in enumerate(costs)]
        sums = heapq.nsmallest(k, merged)
    return sums


Edit = tuple[int, int, list[int]]


def encode_texts(texts: list[str], n: int, memory: Memory) -> list[tuple[np.ndarray, float, list[tuple[float, list[Edit]]]]]:
    """Per text: the ids of its best segmentation, their score, and the other
    segmentations as score and edits ``(at, pieces replaced, ids)`` of the ids."""
    split = [WORD.findall(" " + t) if t else [] for t in texts]
    lengths = np.array([len(w) for w in split])
    codes = memory.numbers([w for words in split for w in words])
    words = memory.known
    sizes = words.sizes[codes]
    ends = np.cumsum(sizes)
    flat = words.ids[np.repeat(words.firsts[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    places = np.concatenate([[0], ends])
    out = []
    for i in range(len(texts)):
        low, high = int(bounds[i]), int(bounds[i + 1])
        own = codes[low:high]
        ids = flat[places[low] : places[high]]
        score = float(words.scores[own].sum())
        others: list[tuple[float, list[Edit]]] = []
        if n > 1 and len(own):
            margins = words.margins[own]
            near = np.argpartition(margins, n - 2)[: n - 1] if len(own) >= n else np.arange(len(own))
            near = np.sort(near[np.isfinite(margins[near])]).tolist()
            lists = [memory.n_best(int(own[j]), n) for j in near]
            costs = [[found[0][0] - s for s, _ in found] for found in lists]
            for cost, chosen in k_least_sums(costs, n)[1:]:
                edits = [
                    (int(places[low + j] - places[low]), int(words.sizes[own[j]]), found[c][1])
                    for j, found, c in zip(near, lists, chosen)
                    if c
                ]
                others.append((score - cost, edits))
        out.append((ids, score, others))
    return out


def apply_edits(ids: list[int], edits: list[Edit]) -> list[int]:
    """The ids of another segmentation from those of the best."""
    out = list(ids)
    for at, replaced, new in sorted(edits, key=lambda e: -e[0]):
        out[at : at + replaced] = new
    return out


def _joined(spelled: list[bytes]) -> str:
    raw = b"".join(spelled)
    return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


def decode_ids(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text that ids stand for; the space put before a text is taken off."""
    return _joined([vocabulary.spelled[i] for i in ids])


EDIT = T.StructType(
    [
        T.StructField("at", T.IntegerType()),
        T.StructField("replaced", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)
OTHER = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("edits", T.ArrayType(EDIT))])
_ARROW_OTHERS = pa.list_(
    pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("replaced", pa.int32()), ("ids", pa.list_(pa.int32()))])))])
)


def encode(docs: DataFrame, vocabulary: Vocabulary, n: int = N_BEST) -> DataFrame:
    """``row`` (the input row), ``ids``, ``score``, ``others``, the next best
    segmentations, and ``round_trip``: whether the ids decode to the text."""
    spelled = np.array(vocabulary.spelled, dtype=object)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(vocabulary)
        for batch in slices(row_texts(batches), "text", SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = encode_texts(texts, n, memory)
            same = [_joined(spelled[ids].tolist()) == t for (ids, _, _), t in zip(found, texts)]
            ends = np.cumsum([0] + [len(ids) for ids, _, _ in found]).astype(np.int32)
            flat = np.concatenate([ids for ids, _, _ in found]).astype(np.int32)
            others = [
                [{"score": s, "edits": [{"at": a, "replaced": r, "ids": x} for a, r, x in edits]} for s, edits in more]
                for _, _, more in found
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array([s for _, s, _ in found], pa.float64()),
                    pa.array(others, _ARROW_OTHERS),
                    pa.array(same, pa.bool_()),
                ],
                ["row", "ids", "score", "others", "round_trip"],
            )

    schema = T.StructType(
        [
            rows.schema["row"],
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("score", T.DoubleType()),
            T.StructField("others", T.ArrayType(OTHER)),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` with ``text``, what its ``ids`` stand for; null ids are empty."""
    spelled = np.array(vocabulary.spelled, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("ids")).fill_null(0).to_numpy(zero_copy_only=False)
            group = (np.cumsum(sizes) - sizes) // PIECES_AT_ONCE
            cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(sizes))
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(low, high - low)
                ends = np.cumsum(sizes[low:high])
                raw = spelled[part.column("ids").flatten().to_numpy()].tolist()
                texts = [_joined(raw[end - size : end]) for end, size in zip(ends.tolist(), sizes[low:high].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    schema = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])
    return encoded.mapInArrow(run, schema)
