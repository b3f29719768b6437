"""Spelling variants: words one edit apart, found by k-d trees of letter counts.

Words of one length are vectors of letter counts, taken apart by place so that
anagrams lie apart too.  One edit moves such a vector by an L1 distance of two
at most, and only in some of its blocks:

* A letter replaced: the counts of each third of the word; one third has one
  letter less and one more, the other two are equal.
* A letter inserted: the counts of the whole word, of its head and of its tail;
  the whole has one letter more, and the head or the tail is equal.

So per pair of lengths the words near a word lie in small boxes around its vector.
There is a k-d tree for each kind of edit and length.  Built from a bounded sample
of words, it cuts the space into cells.  Every word goes to its own cell, and as
a query to the cells of its own length and of the next that one edit may reach.
A task builds a k-d tree of a cell's words, prunes by boxes in the same way, and
verifies the order of letters of what is left.  The sample only places cuts.  A
cell that holds more words than ``PART_WORDS`` is dealt into parts, and its
queries go to each of them.

A word's form is its most frequent near word, if at least twice as frequent; its
root is where following forms ends.  Frequencies double at each step, so a chain
has at most some sixty of them, and pointer doubling needs six rounds.

Edge cases: null texts have no words; a null id is hashed as the empty string;
rows that repeat count each; words may be of any length; an empty table gives an
empty table; ties go to the smaller word in code-point order; other columns are
not read and cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runweave.llm.common import attach_by_key, slices
from runweave.storage import cut_lineage

# The letters of words after A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
SLICE = 1 << 20
# Texts of more characters are read run by run.
LONG_TEXT = 1 << 20
# So many counted words a task keeps before it hands them on.
WORDS_KEPT = 200_000
# About so many words place the cells; so many should share a cell.
SAMPLE_WORDS = 40_000
CELL_WORDS = 4_000
# Words of more characters are not in the sample.
SAMPLED_LENGTH = 64
# The least part of a node's words that a cut must leave on either side.
LEAST_SHARE = 0.05
# Words of a cell that one task holds at a time.
PART_WORDS = 50_000
# Words of a leaf of a task's own tree.
LEAF_WORDS = 48
# Pairs of words compared at once.
COMPARED = 1 << 18
# Words turned into vectors at once.
WORDS_AT_ONCE = 8_000
BLOCK = 90
# Greatest count kept of a letter; a smaller difference prunes less, never more.
MOST = 30_000
ROUTED = "cell long, asks boolean, word string, n long"
NEAR = "word string, near string, near_n long"
REPLACED, INSERTED = 0, 1
BLOCKS = 3
# Blocks that one edit changes, as bits for a letter less and a letter more in each:
# one entry for every place where the edit may be.
PLACES = {REPLACED: [0b000011, 0b001100, 0b110000], INSERTED: [0b110010, 0b001110]}
POSSIBLE = {
    edit: np.array([any(marks & ~place == 0 for place in places) for marks in range(64)]) for edit, places in PLACES.items()
}
# Fixed value: an odd factor for numbering blocks of letters.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Cells are numbered by edit, by the length of their words, and by leaf.
LEAVES = 1 << 20

_index = np.zeros(256, np.int64)
_index[ord("a") : ord("z") + 1] = np.arange(26)
_index[0xC0:] = np.arange(26, BLOCK)


# --------------------------------------------------------------------- words


def _vary(modulus: int, least_length: int):
    run = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def counted(text: str) -> Counter[str]:
        if len(text) <= LONG_TEXT:
            return Counter(run.findall(text))
        return Counter(found[0] for found in run.finditer(text))

    def partial(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in slices(batches, "text", SLICE):
            for name, text in zip(batch.column("id"), batch.column("text")):
                raw = text.as_buffer()
                if raw is None:
                    continue
                begun = zlib.crc32(f"{name.as_py()}:".encode())
                # bytes.lower() changes A-Z alone.  A shorter run gives no word.
                for word, n in counted(raw.to_pybytes().lower().decode()).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % modulus == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    total[word] = total.get(word, 0) + n
            if len(total) > WORDS_KEPT:
                yield partial(total)
                total = {}
        yield partial(total)

    return scan


def vocabulary(docs: DataFrame, modulus: int, least_length: int, least_n: int) -> DataFrame:
    """``word, n`` of the words that occur often enough: runs of letters, of which
    those whose hash with the row's id is divisible by ``modulus`` lose one character."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counted = rows.mapInArrow(_vary(modulus, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_n)


# --------------------------------------------------------------------- trees


def letters(words: list[bytes]) -> np.ndarray:
    """Words of one length in Latin-1, a row each."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def spans(size: int, edit: int, goal: int) -> list[tuple[int, int]]:
    """The places of each block in a word of ``size`` letters that is compared with
    words of ``goal`` letters (as many, or for ``INSERTED`` one more)."""
    if edit == REPLACED:
        return [(size * i // BLOCKS, size * (i + 1) // BLOCKS) for i in range(BLOCKS)]
    head = goal // 2
    tail = goal - 1 - head
    return [(0, size), (0, head), (size - tail, size)]


def vectors(codes: np.ndarray, edit: int, goal: int) -> np.ndarray:
    """Letter counts of words by block."""
    count, size = codes.shape
    rows = np.arange(count)[:, None] * (BLOCK * BLOCKS) + _index[codes]
    spots = np.concatenate([(rows[:, low:high] + i * BLOCK).ravel() for i, (low, high) in enumerate(spans(size, edit, goal))])
    counts = np.bincount(spots, minlength=count * BLOCK * BLOCKS)
    return np.minimum(counts, MOST).astype(np.int16).reshape(count, -1)


@dataclass
class Node:
    dim: int = -1
    cut: int = 0
    left: int = -1
    right: int = -1
    #: Bounds of ``dim`` in this node's box.
    low: int = 0
    high: int = MOST
    #: Number of the leaf, and which of the points it was built from lie in it.
    leaf: int = -1
    points: np.ndarray | None = None


class Tree:
    """A k-d tree over vectors of counts; the leaves' boxes cover all space."""

    def __init__(self, points: np.ndarray, leaf_size: int, least_share: float = 0.0) -> None:
        self.nodes: list[Node] = [Node()]
        self.leaves = 0
        todo: list[tuple[int, np.ndarray, dict[int, tuple[int, int]]]] = [(0, np.arange(len(points)), {})]
        while todo:
            at, own, box = todo.pop()
            node = self.nodes[at]
            best, dim, cut = 0, -1, 0
            if len(own) > leaf_size:
                inside = points[own]
                for c in range(3):
                    below = np.count_nonzero(inside <= c, axis=0)
                    even = np.minimum(below, len(own) - below)
                    if even.max(initial=0) > best:
                        dim, cut = int(even.argmax()), c
                        best = int(even[dim])
            if dim < 0 or best < least_share * len(own):
                node.leaf, node.points = self.leaves, own
                self.leaves += 1
                continue
            node.dim, node.cut = dim, cut
            node.low, node.high = box.get(dim, (0, MOST))
            node.left, node.right = len(self.nodes), len(self.nodes) + 1
            self.nodes += [Node(), Node()]
            goes = points[own, dim] <= cut
            todo.append((node.left, own[goes], box | {dim: (node.low, cut)}))
            todo.append((node.right, own[~goes], box | {dim: (cut + 1, node.high)}))

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, own = todo.pop()
            node = self.nodes[at]
            if node.leaf >= 0:
                out[own] = node.leaf
            else:
                goes = points[own, node.dim] <= node.cut
                todo += [(i, some) for i, some in ((node.left, own[goes]), (node.right, own[~goes])) if len(some)]
        return out

    def reached(self, points: np.ndarray, edit: int) -> Iterator[tuple[Node, np.ndarray]]:
        """Leaves whose box one edit of some points may reach, and those points.

        On the way down a point keeps, as a bit per block and direction, in what
        it lies outside the box by one; no edit moves a block by two.
        """
        columns = np.ascontiguousarray(points.T)
        todo = [(0, np.arange(len(points)), np.zeros(len(points), np.uint8))]
        while todo:
            at, own, outside = todo.pop()
            node = self.nodes[at]
            if node.leaf >= 0:
                yield node, own
                continue
            value = columns[node.dim][own]
            block = node.dim // BLOCK
            for child, far, was, bit in (
                (node.left, value - node.cut, value - node.high, 2 * block),
                (node.right, node.cut + 1 - value, node.low - value, 2 * block + 1),
            ):
                more = np.maximum(far, 0) - np.maximum(was, 0)
                mark = np.uint8(1 << bit)
                now = np.where(more == 1, outside | mark, outside)
                stays = (more == 0) | (more == 1) & (outside & mark == 0)
                some = np.flatnonzero(stays & POSSIBLE[edit][now])
                if len(some):
                    todo.append((child, own[some], now[some]))


Trees = dict[tuple[int, int], Tree]


def cells(words: DataFrame) -> Trees:
    """A tree per edit and length from a sample of ``words`` bounded by ``SAMPLE_WORDS``."""
    every = -(-words.count() // SAMPLE_WORDS) or 1
    by_size: dict[int, list[bytes]] = {}
    # Longer words share the cell of their length; so the sample is small in bytes too.
    sample = words.where((F.pmod(F.xxhash64("word"), F.lit(every)) == 0) & (F.length("word") <= SAMPLED_LENGTH))
    for row in sample.select("word").collect():
        by_size.setdefault(len(row["word"]), []).append(row["word"].encode("latin-1"))
    leaf = max(CELL_WORDS // every, 16)
    return {
        (edit, size): Tree(vectors(letters(some), edit, size), leaf, LEAST_SHARE)
        for size, some in by_size.items()
        for edit in (REPLACED, INSERTED)
    }


def _route(trees: Trees):
    whole = Tree(np.zeros((0, BLOCK * BLOCKS), np.int16), 1)

    def places(codes: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        """Whether words ask, their cells, and which words."""
        size = codes.shape[1]
        every = np.arange(len(codes))
        for edit, goal in ((REPLACED, size), (INSERTED, size), (INSERTED, size + 1)):
            tree = trees.get((edit, goal), whole)
            points = vectors(codes, edit, goal)
            first = (goal * 2 + edit) * LEAVES
            if goal == size:
                yield False, first + tree.leaf_of(points), every
            if (edit == INSERTED) == (goal > size):
                for node, some in tree.reached(points, edit):
                    yield True, np.full(len(some), first + node.leaf), some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.slice(low, WORDS_AT_ONCE)
                words = [w.encode("latin-1") for w in part.column("word").to_pylist()]
                sizes = np.array([len(w) for w in words])
                for size in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == size)
                    for asks, cell, some in places(letters([words[i] for i in own.tolist()])):
                        at = pa.array(own[some])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(cell.astype(np.int64)),
                                pa.array(np.full(len(some), asks)),
                                part.column("word").take(at),
                                part.column("n").take(at),
                            ],
                            ["cell", "asks", "word", "n"],
                        )

    return run


# -------------------------------------------------------------------- search


def ordered(codes: np.ndarray, edit: int, goal: int) -> np.ndarray:
    """A number per block for its letters in their order, equal where they are."""
    keys = np.zeros((len(codes), BLOCKS), np.uint64)
    for i, (low, high) in enumerate(spans(codes.shape[1], edit, goal)):
        for at in range(low, high):
            keys[:, i] = keys[:, i] * FACTOR + codes[:, at]
    return keys


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` (last axis: characters) differ from ``b`` in one place."""
    return np.count_nonzero(a != b, axis=-1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of ``long`` are those of ``short`` with one character more."""
    head = np.logical_and.accumulate(short == long[..., :-1], axis=-1)
    tail = np.logical_and.accumulate((short == long[..., 1:])[..., ::-1], axis=-1)[..., ::-1]
    # The first i characters and all from i on agree, for some i.
    size = short.shape[-1]
    fits = tail[..., 0] | head[..., -1]
    return fits | (head[..., : size - 1] & tail[..., 1:]).any(-1)


class Cell:
    """Words of one length and their tree."""

    def __init__(self, words: list[bytes], edit: int) -> None:
        self.edit = edit
        self.codes = letters(words)
        self.goal = self.codes.shape[1]
        self.keys = ordered(self.codes, edit, self.goal).T.copy()
        self.tree = Tree(vectors(self.codes, edit, self.goal), LEAF_WORDS)

    def near(self, queries: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of queries and of words of the cell that are one edit apart."""
        codes = letters(queries)
        keys = ordered(codes, self.edit, self.goal)
        verified = one_replaced if self.edit == REPLACED else one_inserted
        for node, some in self.tree.reached(vectors(codes, self.edit, self.goal), self.edit):
            points = node.points
            at_once = max(COMPARED // len(points), 1)
            for low in range(0, len(some), at_once):
                own = some[low : low + at_once]
                # All blocks but the one with the edit have the same letters in order.
                one, two, three = (keys[own, i][:, None] == self.keys[i, points] for i in range(BLOCKS))
                q, p = np.nonzero(one & (two | three) | two & three if self.edit == REPLACED else two | three)
                q, p = own[q], points[p]
                fits = verified(codes[q], self.codes[p])
                if fits.any():
                    yield q[fits], p[fits]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell and part, its words before its queries."""
    key, cell, words, counts = None, None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in ("cell", "part", "asks")], axis=1)
        cuts = np.flatnonzero(np.any(place[1:] != place[:-1], axis=1)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if key != tuple(place[low, :2].tolist()):
                key, cell, words, counts = tuple(place[low, :2].tolist()), None, [], []
            part = batch.slice(low, high - low)
            some = [w.encode("latin-1") for w in part.column("word").to_pylist()]
            n = part.column("n").to_pylist()
            if not place[low, 2]:
                words += some
                counts += n
                continue
            if not words:
                continue
            edit = key[0] // LEAVES % 2
            cell = cell or Cell(words, edit)
            for first in range(0, len(some), WORDS_AT_ONCE):
                pairs = list(cell.near(some[first : first + WORDS_AT_ONCE]))
                if not pairs:
                    continue
                asked = (np.concatenate([q for q, _ in pairs]) + first).tolist()
                found = np.concatenate([p for _, p in pairs]).tolist()
                a, b = [some[i] for i in asked], [words[j] for j in found]
                m, k = [counts[j] for j in found], [n[i] for i in asked]
                if edit == INSERTED:
                    # Only the shorter of the two words has asked.
                    a, b, m = a + b, b + a, m + k
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x.decode("latin-1") for x in a], pa.string()),
                        pa.array([x.decode("latin-1") for x in b], pa.string()),
                        pa.array(m, pa.int64()),
                    ],
                    ["word", "near", "near_n"],
                )


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: every ordered pair of ``words`` (``word, n``, each
    word once, letters a-z and U+00C0 to U+00FF) that is one edit apart."""
    routed = cut_lineage(words.select("word", "n").mapInArrow(_route(cells(words)), ROUTED), "cells")
    sizes = routed.where("not asks").groupBy("cell").agg(F.count("*").alias("held"))
    # Cells are bounded in number, by the sample; only the crowded are listed.
    crowded = {r["cell"]: -(-r["held"] // PART_WORDS) for r in sizes.where(F.col("held") > PART_WORDS).collect()}
    parts: Column = F.lit(1)
    if crowded:
        table = F.create_map(*[F.lit(x) for pair in crowded.items() for x in pair])
        parts = F.coalesce(table[F.col("cell")], F.lit(1))
    dealt = routed.withColumn("parts", parts.cast("int"))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    goes = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)
    placed = dealt.select("cell", F.explode(goes).alias("part"), "asks", "word", "n")
    return placed.repartition("cell", "part").sortWithinPartitions("cell", "part", "asks").mapInArrow(_search, NEAR)


# --------------------------------------------------------------------- forms


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where following ``form`` from ``word`` ends."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = attach_by_key(now, ahead, "root", "word")
        moved = cut_lineage(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def spelling_groups(
    docs: DataFrame, modulus: int = 97, least_length: int = 5, least_n: int = 3, times: int = 2
) -> DataFrame:
    """Every word as ``word, form, root, n, n_near, form_n``."""
    words = cut_lineage(vocabulary(docs, modulus, least_length, least_n), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("down"), F.col("near").alias("near")))
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = -F.col("best.down") >= times * F.col("n")
    rows = words.join(found, "word", "left").select(
        "word",
        F.when(chosen, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, -F.col("best.down")).alias("form_n"),
    )
    rows = cut_lineage(rows, "forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
