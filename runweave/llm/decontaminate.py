"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows of ``WINDOW`` consecutive words (an item
with fewer words is one window).  A window is a set of placed shingles of
``SHINGLE`` words.  A document contains a window exactly if it has all its
shingles at the window's distances, so one shingle, the rarest in the documents,
is the necessary prefix: only where a document has it can the window be.  The
places found are bounded by the document's length and then verified by all
shingles of the window, in order.

Shingles are compared by 64-bit hashes of their words; a window by the hashes of
all its shingles, which overlap.  All steps are DataFrame functions.

Skew: the documents are cut into words once, joined to the benchmark's shingles
where they are read, and only matching shingles are written and shuffled, by row.
The benchmark side is broadcast up to ``BROADCAST_BYTES`` by its counted size and
shuffled beyond.

Edge cases: null and wordless texts have no words, are hit by nothing and are not
contaminated; a wordless item has no window; items that repeat each count; rows
that repeat are each reported.  Other columns are not read and cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from runweave.llm.common import ascii_lower
from runweave.storage import cut_lineage

WINDOW = 13
SHINGLE = 3
# A document is contaminated if at least one word in so many is hit.
ONE_WORD_IN = 20
# The separators of lower-cased text: ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Up to this size the benchmark's shingles go to every executor.
BROADCAST_BYTES = 64 << 20
# Of a shingle in a join: hash, length, row overhead.
SHINGLE_BYTES = 64


def words_of(col: str) -> Column:
    return F.array_remove(F.split(ascii_lower(col), SEPARATORS), "")


def _shingles_at(words: str, places: Column, k: int) -> Column:
    """Hashes of the ``k`` words from each place on."""
    return F.transform(places, lambda p: F.xxhash64(F.lit(k), *[F.get(words, p + i) for i in range(k)]))


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id, wkey, length, k, shingles`` of every window of every item."""
    cut = items.select("item_id", words_of("text").alias("words")).where("size(words) > 0")
    cut = cut.withColumn("length", F.least(F.size("words"), F.lit(WINDOW)))
    cut = cut.withColumn("k", F.least("length", F.lit(SHINGLE)))
    starts = F.sequence(F.lit(0), F.size("words") - F.col("length"))
    windows = cut.select("item_id", "words", "length", "k", F.explode(starts).alias("start"))
    places = F.sequence(F.col("start"), F.col("start") + F.col("length") - F.col("k"))
    shingles = F.lit(None)
    for k in range(1, SHINGLE + 1):
        shingles = F.when(F.col("k") == k, _shingles_at("words", places, k)).otherwise(shingles)
    return windows.select("item_id", "length", "k", shingles.alias("shingles")).withColumn("wkey", F.xxhash64("length", "shingles"))


def _placed_by(k: int) -> Callable[[Column, Column], Column]:
    return lambda h, pos: F.struct(F.lit(k).alias("k"), pos.alias("pos"), h.alias("shingle"))


def _sized(small: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(small) if n_rows * SHINGLE_BYTES <= BROADCAST_BYTES else small


def matching_shingles(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per document (``pos`` null) and one per place where a document has
    a shingle of the benchmark: ``row_id, doc_id, mark, n_words, k, pos, shingle``;
    ``mark`` is a hash of the text."""
    wanted = windows.select("k", F.explode("shingles").alias("shingle")).distinct()
    wanted = cut_lineage(wanted.select(F.col("shingle").alias("hash"), F.col("k").alias("of")), "shingles")
    found = wanted.groupBy("of").count().collect()  # at most SHINGLE rows
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("mark"), words_of("text").alias("words"), F.monotonically_increasing_id().alias("row_id")
    )
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    parts = [F.array(F.struct(F.lit(0).alias("k"), F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("shingle")))]
    for r in found:
        k = r["of"]
        places = F.when(F.col("n_words") >= k, F.sequence(F.lit(0), F.col("n_words").cast("int") - k)).otherwise(F.array().cast("array<int>"))
        hashes = _shingles_at("words", places, k)
        parts.append(F.transform(hashes, _placed_by(k)))
    placed = rows.select("row_id", "doc_id", "mark", "n_words", F.explode(F.concat(*parts)).alias("s"))
    placed = placed.select("row_id", "doc_id", "mark", "n_words", "s.*")
    small = _sized(wanted, sum(r["count"] for r in found))
    joined = placed.join(small, (F.col("shingle") == F.col("hash")) & (F.col("k") == F.col("of")), "left")
    return joined.where("hash is not null or k = 0").drop("hash", "of")


def window_hits(matches: DataFrame, windows: DataFrame) -> DataFrame:
    """``row_id, start, length, wkey``: every place of every window."""
    places = matches.where("k > 0").select("row_id", "n_words", "k", "pos", "shingle")
    kinds = windows.select("wkey", "length", "k", "shingles").dropDuplicates(["wkey"])
    kinds = cut_lineage(kinds, "windows")
    # Rarity order: how often the documents have each shingle.
    rarity = places.groupBy("k", "shingle").agg(F.count(F.lit(1)).alias("n"))
    tokens = kinds.select("wkey", "length", "k", F.posexplode("shingles").alias("offset", "shingle"))
    ranked = tokens.join(rarity, ["k", "shingle"], "left")
    # A window with a shingle that no document has is nowhere.
    prefix = ranked.groupBy("wkey", "length", "k").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("rarest")
    )
    prefix = prefix.where("rarest.n > 0").select("wkey", "length", "k", F.col("rarest.offset").alias("offset"), F.col("rarest.shingle").alias("shingle"))
    prefix = cut_lineage(prefix, "prefixes")
    by_length = prefix.groupBy("length", "k").count().collect()  # at most WINDOW rows
    found = places.join(_sized(prefix, sum(r["count"] for r in by_length)), ["k", "shingle"])
    found = found.withColumn("start", F.col("pos") - F.col("offset"))
    candidates = found.where("start >= 0 and start + length <= n_words").select("row_id", "start", "length", "wkey")
    # What a document has at each place, over as many shingles as a window has.
    seen = None
    for r in by_length:
        length, k = r["length"], r["k"]
        more = length - k
        ahead = Window.partitionBy("row_id").orderBy("pos").rowsBetween(0, more)
        run = (
            places.where(F.col("k") == k)
            .withColumn("_run", F.collect_list("shingle").over(ahead))
            .withColumn("_end", F.max("pos").over(ahead))
            .where((F.size("_run") == more + 1) & (F.col("_end") == F.col("pos") + more))
            .select("row_id", F.col("pos").alias("start"), F.xxhash64(F.lit(length), "_run").alias("wkey"))
        )
        seen = run if seen is None else seen.unionByName(run)
    if seen is None:
        return candidates
    return candidates.join(seen, ["row_id", "start", "wkey"]).select("row_id", "start", "length", "wkey")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items, contaminated``;
    ``items`` are the ids of the items with a window in the document, as strings
    in order."""
    windows = cut_lineage(item_windows(items), "item-windows")
    matches = cut_lineage(matching_shingles(docs, windows), "matches")
    hits = cut_lineage(window_hits(matches, windows), "hits")
    before = Window.partitionBy("row_id").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    places = hits.select("row_id", "start", "length").distinct()
    covered = F.col("start") + F.col("length") - F.greatest(F.col("start"), F.coalesce(F.col("_to"), F.col("start")))
    lengths = (
        places.withColumn("_to", F.max(F.col("start") + F.col("length")).over(before))
        .groupBy("row_id")
        .agg(F.sum(F.greatest(covered, F.lit(0))).cast("long").alias("n_hit"))
    )
    owners = windows.select("wkey", F.col("item_id").cast("string").alias("item")).distinct()
    listed = (
        hits.select("row_id", "wkey")
        .distinct()
        .join(owners, "wkey")
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    out = matches.where("k = 0").select("row_id", "doc_id", "mark", "n_words")
    out = out.join(lengths, "row_id", "left").join(listed, "row_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        found.alias("items"),
        ((n_hit > 0) & (n_hit * ONE_WORD_IN >= F.col("n_words"))).alias("contaminated"),
        "mark",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they are."""
    bad = contamination(docs, items).where("contaminated").select("doc_id", "mark").distinct()
    bad = cut_lineage(bad.select(F.col("doc_id").alias("_bad_id"), F.col("mark").alias("_bad_mark")), "contaminated")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("_row.text") == F.col("_bad_mark"))
    return rows.join(_sized(bad, bad.count()), same, "left_anti").select("_row.*")
