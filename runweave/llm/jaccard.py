"""Near-duplicates by a parity-sketch join of shingle sets.

Two sets link when ``100 * intersection >= percent * union``; then their
symmetric difference is at most a known number for their sizes.  Every set is
XOR-hashed into a bit sketch: each shingle flips one bit.  The Hamming distance of
two sketches, in bits or in blocks of bits, is at most the symmetric difference,
so if the sketch of a size band is cut into one block more than differences are
allowed, two linked sets have a block in common.  Sets therefore meet by (band, block, value) keys, are compared
by the Hamming distance of whole sketches, and are verified on their shingles.

* Texts with equal sets are one class; its keys leave a task once.
* Keys are shuffled alone, with the class.  The classes that share a key form a
  family named after its least member.
* Members of a family are compared by the Hamming distance of small sketches, in
  blocks of bounded size; what leaves a task is which members have a partner.
  Only of those the shingles are read again.
* They are first compared with the least member, a linear number of pairs.  Only
  members that do not link with it are compared with the others, again in blocks,
  of which just a spanning set of links leaves the task.
* Empty blocks tell little, so a sketch has as many blocks as leave some that are
  neither empty nor touched by a difference; a set for which they do not also
  brings its empty blocks.
* Links become components by star contraction; nothing of it is on the driver.

Edge cases: null and wordless texts have an empty set, link with nothing and are
components of their own; a text of fewer words than a shingle is one shingle;
rows that repeat share a component; a null id never names a component unless its
component has no other.  Shingles and sets are identified by 64-bit hashes.  Other columns
are not read and cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from runweave.llm.common import attach_by_key, bucket_of, keep_rows, slices
from runweave.llm.components import components
from runweave.llm.hashing import U64, mix, shingle_sets
from runweave.storage import cut_lineage, discard, files_for

# A task tokenises about this many bytes of text at a time.
SLICE = 1 << 19
# Shingles of a family in one comparison task.
BLOCK_SHINGLES = 200_000
# Members of a family in one part of it.
BLOCK_MEMBERS = 256
# A sketch has about so many bits for each difference that is allowed.
BITS_A_DIFFERENCE = 4
# Into so many buckets ids are hashed to tell early which texts are read again;
# the table of buckets is broadcast, 8 bytes each.
ID_BUCKETS = 1 << 20
# Sketches, and sets of shingles, that one file of a table may have.
SKETCHES_A_FILE, SETS_A_FILE = 20_000, 5_000

SKETCHES = "doc_id long, row_id long, n_shingles long, class_id long, sha string, sketch binary"


def allowed(a: int, b: int, percent: int) -> int:
    """The greatest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


class Bands:
    """Size bands such that linked sets lie in one band or in neighbours."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        low = 1
        while allowed(low, low * 100 // percent, percent) < 1:
            low += 1
        # A smaller set links only with its equal.
        self.least = low
        self.high = [low]
        self.counted: dict[int, int] = {}

    def of(self, n: int) -> int:
        """The band of a size, -1 below the least."""
        while self.high[-1] < n:
            self.high.append(max(self.high[-1] + 1, self.high[-1] * 100 // self.percent))
        return -1 if n < self.least else int(np.searchsorted(self.high, n))

    def differences(self, band: int) -> int:
        """Allowed for a pair whose smaller set is in this band."""
        high = self.high[band]
        return allowed(high, high * 100 // self.percent, self.percent)

    def blocks_of(self, band: int) -> int:
        if band not in self.counted:
            self.counted[band] = self.blocks(band)
        return self.counted[band]

    def blocks(self, band: int) -> int:
        """Blocks of a sketch for such pairs: of the smallest sets of the band
        most leave a filled block that no difference touches."""
        low = self.high[band - 1] + 1 if band else self.least
        spoiled = self.differences(band)
        n = spoiled + 1
        while n <= 2 * spoiled:
            empty = n * np.exp(-low / n)
            if n - empty - 2 * np.sqrt(empty) > spoiled:
                break
            n += 1
        return n


def sketch_words(n: int, percent: int) -> int:
    """64-bit words of the sketch of a set, a power of two."""
    bits = BITS_A_DIFFERENCE * (allowed(n, n * 100 // percent, percent) + 1)
    return 1 << max(0, (-(-bits // 64) - 1).bit_length())


def parity_sketch(shingles: np.ndarray, words: int) -> np.ndarray:
    """Each shingle flips one of ``64 * words`` bits."""
    bits = (shingles % U64(64 * words)).astype(np.int64)
    odd = np.bincount(bits, minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(U64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch with fewer words that the same set would have."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def block_values(shingles: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """What each block of a sketch holds, and how many shingles: the XOR of their
    hashes, which is a hash of the block's parity bits at any width.  Blocks are
    equal ranges of the hash, so they are runs of the sorted shingles."""
    edges = [-(-(j << 64) // blocks) for j in range(1, blocks)]
    ends = np.concatenate([np.searchsorted(shingles, np.array(edges, U64)), [len(shingles)]])
    so_far = np.concatenate([np.zeros(1, U64), np.bitwise_xor.accumulate(shingles)])[ends]
    return so_far ^ np.concatenate([np.zeros(1, U64), so_far[:-1]]), np.diff(ends, prepend=0)


def band_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys by which a set meets those of its band and of the next ones.

    Of two linked sets either one has more filled blocks than differences are
    allowed, so that a filled block is equal, or both bring empty blocks too.
    """
    own = bands.of(len(shingles))
    keys = []
    for band in (own - 1, own):
        if band >= 0:
            values, filled = block_values(shingles, bands.blocks_of(band))
            place = (np.arange(len(values), dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(band)
            found = mix(values ^ mix(place))
            keys.append(found[filled > 0] if np.count_nonzero(filled) > bands.differences(band) else found)
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def class_number(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "big", signed=True)


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    """Texts as bytes in A-Z lower case; null is empty."""
    return [b"" if (x := t.as_buffer()) is None else x.to_pybytes() for t in batch.column("text")]


def sketches(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """Size, class and sketch of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            raw = _raw(batch)
            sets = shingle_sets([t.lower() for t in raw], k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_number(s) for s in sets], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
                    pa.array([parity_sketch(s, sketch_words(len(s), percent)).tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "row_id", "n_shingles", "class_id", "sha", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row_id"))
    return rows.mapInArrow(run, SKETCHES)


def _families(docs: DataFrame, percent: int, k: int, files: int) -> DataFrame:
    """``leader, rid`` of classes that share a key with a class of lesser number,
    in at most so many files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in slices(batches, "text", SLICE):
            rids, keys = [], []
            for s in shingle_sets([t.lower() for t in _raw(batch)], k):
                # Copies of a text bring its keys once a task.
                if len(s) >= bands.least and (rid := class_number(s)) not in seen:
                    seen.add(rid)
                    keys.append(band_keys(s, bands))
                    rids.append(np.full(len(keys[-1]), rid, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rids)), pa.array(np.concatenate(keys))], ["rid", "key"])

    keyed = docs.select("text").mapInArrow(run, "rid long, key long")
    so_far = Window.partitionBy("key").orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)
    met = keyed.withColumn("leader", F.min("rid").over(so_far)).where("leader < rid")
    return cut_lineage(met.select("leader", "rid").distinct().coalesce(files), "families")


def _parts(shingles: Column, members: Column) -> Column:
    """Into how many parts a family is dealt."""
    by_size = F.ceil(shingles / BLOCK_SHINGLES)
    return F.greatest(by_size, F.ceil(members / BLOCK_MEMBERS)).cast("int")


def _promising(families: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``families`` without members that by their sketch link with no other, and
    ``n``, the size of a member's set."""
    files = files_for(2 * families.count())
    facts = classes.select("rid", "n", "sketch")
    whole = families.unionByName(families.select("leader", F.col("leader").alias("rid")).distinct())
    # Read several times below, so written: the driver holds small plans.
    sized = cut_lineage(whole.join(facts.select("rid", "n"), "rid").coalesce(files), "sized")
    parts = sized.groupBy("leader").agg(_parts(F.sum("n"), F.count("rid")).alias("parts"))
    dealt = attach_by_key(sized, parts, "leader", "rid")
    part = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    # A task has two parts of a family, or one part by itself.
    dealt = dealt.select("leader", "rid", part.alias("part"), F.explode(others).alias("other"))
    task = ["leader", "row", "col"]
    pairs = dealt.select("leader", F.least("part", "other").alias("row"), F.greatest("part", "other").alias("col"), "rid")
    ordered = pairs.join(facts, "rid").repartition(*task).sortWithinPartitions(*task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (leader, _, _), group in _groups(batches, task):
            near = promising_members(group, percent)
            if near:
                rids, sizes = zip(*near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([leader] * len(near), pa.int64()), pa.array(rids, pa.int64()), pa.array(sizes, pa.int64())],
                    ["leader", "rid", "n"],
                )

    found = ordered.select(*task, "rid", "n", "sketch").mapInArrow(run, "leader long, rid long, n long")
    promising = cut_lineage(found.where("leader <> rid").distinct().coalesce(files), "promising")
    discard(families.sparkSession, sized)
    return promising


def promising_members(group: list[dict], percent: int) -> list[tuple[int, int]]:
    """The members of a block that are near another one by their sketches, and
    the sizes of their sets."""
    rows = sorted(group, key=lambda r: r["n"])
    sketches = [np.frombuffer(r["sketch"], U64) for r in rows]
    words = min(len(s) for s in sketches)
    matrix = np.stack([folded(s, words) for s in sketches])
    sizes = np.array([r["n"] for r in rows])
    highs = np.searchsorted(sizes, sizes * 100 // percent + 1)
    near = np.zeros(len(rows), bool)
    for i in range(len(rows)):
        others = slice(i + 1, int(highs[i]))
        apart = np.bitwise_count(matrix[others] ^ matrix[i]).sum(1, dtype=np.int64)
        close = apart <= (100 - percent) * (sizes[i] + sizes[others]) // (100 + percent)
        near[others] |= close
        near[i] |= bool(close.any())
    return [(r["rid"], r["n"]) for r, is_near in zip(rows, near) if is_near]


def _member_sets(docs: DataFrame, families: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``rid, n, shingles`` of every class in a family, from its first text."""
    members = families.select(F.explode(F.array("leader", "rid")).alias("rid")).distinct()
    n_members = 2 * families.count()
    members = members.join(classes.select("rid", "rid_doc"), "rid").coalesce(files_for(n_members))
    members = cut_lineage(members, "members")
    doc_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    members = members.select("rid", F.coalesce("rid_doc", F.lit(-(2**63))).alias("_id"))
    buckets = members.select(bucket_of(ID_BUCKETS, "_id").alias("_bucket")).distinct()
    texts = docs.select(doc_key.alias("_id"), F.col("text"))
    texts = texts.withColumn("_bucket", bucket_of(ID_BUCKETS, "_id"))
    texts = texts.join(F.broadcast(buckets), "_bucket", "left_semi").drop("_bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets([t.lower() for t in _raw(batch)], k)
            # Ids may repeat: another text of the same id is another class.
            right = [class_number(s) == rid for s, rid in zip(sets, batch.column("rid").to_pylist())]
            mine = pa.array(right)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid").filter(mine),
                    pa.array([len(s) for s, r in zip(sets, right) if r], pa.int64()),
                    pa.array([s.tobytes() for s, r in zip(sets, right) if r], pa.binary()),
                ],
                ["rid", "n", "shingles"],
            )

    found = texts.join(members, "_id").select("rid", "text").mapInArrow(run, "rid long, n long, shingles binary")
    sets = found.groupBy("rid").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    sets = cut_lineage(sets.coalesce(files_for(n_members, SETS_A_FILE)), "sets")
    discard(docs.sparkSession, members)
    return sets


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(b) else 0


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = _common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with equal keys, as dicts; a group may span batches."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[c] for c in keys)
            if now != key and held:
                yield key, held
                held = []
            key = now
            held.append(row)
    if held:
        yield key, held


def _with_leader(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``families`` with ``linked``: whether a member links with the least one.

    A large family is dealt out in parts, each with a copy of the leader; a task
    holds the leader's shingles and one member's at a time.
    """
    weight = families.groupBy("leader").agg(_parts(F.sum("n"), F.count("rid")).alias("parts"))
    dealt = attach_by_key(families, weight, "leader", "rid")
    part = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part")
    # Every member, and the leader once a part.
    dealt = dealt.select("leader", part, F.explode(F.array("leader", "rid")).alias("rid")).distinct()
    rows = dealt.join(sets.select("rid", "shingles"), "rid")
    # By the arrangement below the leader is the first of its part.
    ordered = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_set = None, np.zeros(0, U64)
        for batch in batches:
            leaders, rids, sizes, linked = [], [], [], []
            shingles = batch.column("shingles")
            for i, (leader, rid) in enumerate(zip(batch.column("leader").to_pylist(), batch.column("rid").to_pylist())):
                own = np.frombuffer(shingles[i].as_buffer(), U64)
                if rid == leader:
                    head, head_set = leader, own.copy()
                    continue
                if head != leader:
                    raise ValueError("a family's least member is missing")
                leaders.append(leader)
                rids.append(rid)
                sizes.append(len(own))
                linked.append(_linked(head_set, own, percent))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaders, pa.int64()), pa.array(rids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(linked, pa.bool_())],
                ["leader", "rid", "n", "linked"],
            )

    out = ordered.select("leader", "part", "rid", "shingles").mapInArrow(run, "leader long, rid long, n long, linked boolean")
    # Compared in many tasks, kept in few files.
    return cut_lineage(out.repartition(files_for(families.count())), "with-leader")


def _among_members(compared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that span what members of a family other than the least
    have among each other, where at least one does not link with the least."""
    free = F.when(~F.col("linked"), F.col("n"))
    shape = compared.groupBy("leader").agg(
        _parts(F.sum(free), F.count(free)).alias("row_parts"),
        _parts(F.sum("n"), F.count("rid")).alias("col_parts"),
        F.count("rid").alias("members"),
    )
    shape = shape.where("row_parts > 0 and members > 1").drop("members")
    dealt = attach_by_key(compared, shape, "leader", "rid").where("row_parts is not null")
    row = F.pmod(F.xxhash64("rid"), F.col("row_parts")).cast("int")
    col = F.pmod(F.xxhash64("rid"), F.col("col_parts")).cast("int")
    rows_of, cols_of = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("row_parts", "col_parts"))
    # A task has one part of the free members and one of all members.
    as_free = F.transform(cols_of, lambda c: F.struct(row.alias("row"), c.alias("col"), F.lit(True).alias("free")))
    as_any = F.transform(rows_of, lambda r: F.struct(r.alias("row"), col.alias("col"), F.lit(False).alias("free")))
    spots = F.when(F.col("linked"), as_any).otherwise(F.concat(as_free, as_any))
    task = ["leader", "row", "col"]
    rows = dealt.select("leader", "rid", "linked", F.inline(spots)).join(sets.select("rid", "shingles"), "rid")
    ordered = rows.repartition(*task).sortWithinPartitions(*task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, task):
            links = block_links(group, percent)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return ordered.select(*task, "rid", "linked", "free", "shingles").mapInArrow(run, "a long, b long")


def block_links(group: list[dict], percent: int) -> list[tuple[int, int]]:
    """Verified links between the free rows and all rows of one block, as many
    as are needed to connect what the block connects."""
    sets = {r["rid"]: np.frombuffer(r["shingles"], U64) for r in group}
    root = {r: r for r in sets}
    # Members that link with the least one are connected already.
    near = [r["rid"] for r in group if r["linked"]]
    for r in near:
        root[r] = near[0]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    others = np.array(sorted({r["rid"] for r in group if not r["free"]}, key=lambda r: len(sets[r])))
    sizes = np.array([len(sets[r]) for r in others])
    words = sketch_words(int(sizes[-1]), percent) if len(others) else 1
    sketch = {r: parity_sketch(s, words) for r, s in sets.items()}
    matrix = np.stack([sketch[r] for r in others]) if len(others) else np.zeros((0, words), U64)
    links = []
    for a in sorted(r["rid"] for r in group if r["free"]):
        n = len(sets[a])
        low, high = np.searchsorted(sizes, [-(-n * percent // 100), n * 100 // percent + 1])
        apart = np.bitwise_count(matrix[low:high] ^ sketch[a]).sum(1, dtype=np.int64)
        bound = (100 - percent) * (n + sizes[low:high]) // (100 + percent)
        for b in others[low:high][apart <= bound].tolist():
            if b != a and find(a) != find(b) and _linked(sets[a], sets[b], percent):
                root[find(a)] = find(b)
                links.append((a, b))
    return links


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 3) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, sha, row_id, root``; the
    component is named after its smallest ``doc_id``.  ``root`` tells components
    apart even where ids repeat."""
    sketched = cut_lineage(sketches(docs, percent, k), "sketches")
    classes = (
        sketched.where("n_shingles > 0")
        .groupBy(F.col("class_id").alias("rid"))
        .agg(
            F.min(F.struct("row_id", "doc_id"))["doc_id"].alias("rid_doc"),
            F.min("doc_id").alias("least"),
            F.min("n_shingles").alias("n"),
            F.min("sketch").alias("sketch"),
        )
    )
    files = files_for(sketched.count(), SKETCHES_A_FILE)
    classes = cut_lineage(classes.coalesce(files), "classes")
    met = _families(docs, percent, k, files)
    families = _promising(met, classes, percent)
    discard(docs.sparkSession, met)
    sets = _member_sets(docs, families, classes, k)
    compared = _with_leader(families, sets, percent)
    links = compared.where("linked").select(F.col("leader").alias("a"), F.col("rid").alias("b"))
    links = links.unionByName(_among_members(compared, sets, percent))
    roots = components(links, "a", "b")
    discard(docs.sparkSession, families, sets, compared)
    # What is linked gets its name once; a class without links has its own.
    linked = classes.select("rid", "least").join(roots.withColumnRenamed("id", "rid"), "rid")
    names = linked.groupBy("root").agg(F.min("least").alias("name"))
    linked = attach_by_key(linked, names, "root", "rid").select("rid", "root", "name")
    linked = cut_lineage(linked.coalesce(files_for(roots.count())), "links-named")
    discard(docs.sparkSession, roots)
    named = classes.select("rid", "least").join(linked, "rid", "left").select(
        F.col("rid").alias("class_id"), F.coalesce("root", "rid").alias("root"), F.coalesce("name", "least").alias("component_id")
    )
    rows = sketched.select("doc_id", "row_id", "n_shingles", "class_id", "sha")
    found = attach_by_key(rows, named, "class_id", "row_id")
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "sha",
        "row_id",
        "root",
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80, k: int = 3) -> DataFrame:
    """Of each component the row with the smallest id stays (of several with that
    id the one with the least text digest), with all its columns.  Wordless rows
    all stay; rows equal in id and text are one."""
    found = cut_lineage(near_duplicates(docs, percent, k), "found")
    named = (F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    head = found.where(named).groupBy("root").agg(F.min(F.struct("sha", "doc_id")).alias("head"))
    # Rows beside the one that stays go; most components have a single row.
    rows = attach_by_key(found.select("root", "row_id", "doc_id", "sha", "n_shingles"), head, "root", "row_id")
    same = F.struct("sha", "doc_id").eqNullSafe(F.struct("head.sha", "head.doc_id"))
    decided = rows.select("doc_id", "sha", ((F.col("n_shingles") == 0) | same).alias("kept"))
    kept = keep_rows(docs, decided, F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256), "sha")
    # Ids and marks of the rows that go are written by now.
    discard(docs.sparkSession, found)
    return kept
