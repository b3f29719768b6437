"""Exact and near-duplicates, decontamination, shards: edges and brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from runweave.llm import common, components as components_module, exact, jaccard
from runweave.llm.components import components
from runweave.llm.decontaminate import contamination, drop_contaminated
from runweave.llm.exact import drop_exact_duplicates, exact_duplicates
from runweave.llm.hashing import CHUNK, shingle_sets, word_hashes
from runweave.llm.jaccard import Bands, allowed, band_keys, drop_near_duplicates, folded, near_duplicates, parity_sketch
from runweave.llm.queries import op1_exact_dedup, op7_jaccard_join, op9_sharding
from runweave.llm.sharding import add_shard, first_map, rebalance, shard_by_bytes
from runweave.storage import cut_lineage


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_components(rows, percent, k):
    sets = [(d, shingles(t, k)) for d, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    names = defaultdict(list)
    for i, (d, a) in enumerate(sets):
        if a and d is not None:
            names[find(i)].append(d)
    return [(d, len(a), min(names[find(i)], default=None) if a else d) for i, (d, a) in enumerate(sets)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("levels", [1, 3])
def test_exact_edges(spark, odd_docs, keep, levels):
    got = exact_duplicates(odd_docs, keep, levels).collect()
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[lower(r.text)].append(r.doc_id)
    pick = max if keep == "largest" else min
    want = Counter((i, pick([x for x in g if x is not None], default=None), len(g)) for g in groups.values() for i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = drop_exact_duplicates(odd_docs, keep, levels)
    assert kept.columns == odd_docs.columns and kept.count() == len(groups)


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert exact_duplicates(no_docs).count() == 0
    assert near_duplicates(no_docs).count() == 0
    assert contamination(no_docs, items).count() == 0
    assert drop_contaminated(no_docs, items).count() == 0
    assert shard_by_bytes(no_docs, 4)[0].count() == 0


@pytest.mark.parametrize("percent,k", [(90, 3), (80, 5)])
def test_near_duplicates_against_brute_force(spark, odd_docs, percent, k):
    rng = random.Random(percent)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 9, 14, 40, 150]))] for _ in range(25)]
    texts = []
    for words in base:
        for _ in range(5):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent, k)
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()]
    assert Counter(found) == Counter(brute_components(rows, percent, k))


def test_near_duplicates_of_the_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = op7_jaccard_join(spark, tables).collect()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 90, 3)
    assert Counter(map(tuple, got)) == Counter(want)


def test_one_of_each_near_group_stays(spark, odd_docs):
    kept = drop_near_duplicates(odd_docs, 80, 5)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[6] == 1 and ids[7] == 0
    assert ids[3] == ids[4] == ids[5] == 1 and ids[10] == 2


def test_linked_sets_always_share_a_key():
    rng = np.random.default_rng(3)
    for percent in (80, 90, 95):
        bands = Bands(percent)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            m = int(rng.integers(n, n * 100 // percent + 1))
            most = min(allowed(len(a), m, percent), len(a))
            out = max(0, (most - (m - len(a))) // 2)
            b = np.unique(np.concatenate([a[out:], rng.integers(0, 1 << 63, m - len(a) + out).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both) or len(a) == len(b) == both:
                continue
            assert set(band_keys(a, bands).tolist()) & set(band_keys(b, bands).tolist())
            far, near = parity_sketch(a, 8), parity_sketch(b, 8)
            assert int(np.bitwise_count(far ^ near).sum()) <= len(a) + len(b) - 2 * both
            assert (folded(far, 2) == parity_sketch(a, 2)).all()


def test_word_hashes_do_not_depend_on_chunks():
    words = [b"a", "é".encode(), b"x" * (CHUNK + 5), b"tail", b"a"]
    at, hashes = word_hashes(b" ".join(words) + b"\x0b\x0c\r\n")
    assert len(at) == 5 and hashes[0] == hashes[4] and len(set(hashes.tolist())) == 4
    filler = b"q " * CHUNK
    assert word_hashes(filler + b"needle")[1][-1] == word_hashes(b"needle")[1][0]
    one, two, three = shingle_sets([b"a b", b"a b c", b"b a"], 3)
    assert len({int(one[0]), int(two[0]), int(three[0])}) == 3


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 200), (200, 300), (5, 5)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[300] == 200


def test_decontamination_against_brute_force(spark, odd_docs):
    rng = random.Random(5)
    word = lambda: f"W{rng.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 13, 14, 20, 0])] + [(8, None), (9, "w1, w2! W3")]
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for i in range(40):
        text = [word() for _ in range(rng.choice([1, 4, 30, 200]))]
        if i % 2:
            text[rng.randrange(len(text)) :] = (items[rng.randrange(8)][1] or "").split()
        docs.append((100 + i, "; ".join(text)))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    want = []
    for d, text in docs:
        words, hit, found = split(text), set(), set()
        for item, t in items:
            own = split(t)
            n = min(13, len(own))
            for w in range(len(own) - n + 1 if n else 0):
                for s in range(len(words) - n + 1):
                    if words[s : s + n] == own[w : w + n]:
                        hit |= set(range(s, s + n))
                        found.add(str(item))
        want.append((d, len(words), len(hit), len(found), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(words)))
    found = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in found.collect()]
    assert Counter(got) == Counter(want)


def test_clean_rows_stay_as_they_are(spark, odd_docs):
    items = spark.createDataFrame([(1, "hello the world and the rest")], "item_id long, text string")
    kept = drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.count() - 3


def test_shards_are_even_and_gapless(spark, tables):
    rows = op9_sharding(spark, tables).toPandas()
    sizes = rows.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    longest = rows["size"].max()
    assert sizes.max() - sizes.min() <= longest
    for _, shard in rows.groupby("shard"):
        assert sorted(shard["slot"]) == list(range(len(shard)))
    again = op9_sharding(spark, tables).toPandas()
    assert dict(zip(rows.doc_id, rows.shard)) == dict(zip(again.doc_id, again.shard))


def test_a_hot_id_is_split_over_shards(spark):
    rows = spark.range(3_000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "repeat('x', 40) as text")
    placed, slot_map = shard_by_bytes(rows, 8)
    sizes = [r.s for r in placed.groupBy("shard").sum("size").toDF("shard", "s").collect()]
    assert max(sizes) < 1.02 * sum(sizes) / 8
    assert {r.version for r in slot_map.select("version").distinct().collect()} == {1, 2}


def test_a_new_shard_takes_slots_only_into_itself():
    rng = random.Random(1)
    loads = {(s, -1): rng.randrange(1, 1_000) for s in range(2_000)}
    old = rebalance(first_map(loads, 10), loads, 10)
    new = add_shard(old, loads, 10)
    assert all(new[u] in (old[u], 10) for u in loads)
    totals = [sum(loads[u] for u in loads if new[u] == s) for s in range(11)]
    assert max(totals) - min(totals) < 0.02 * sum(totals) / 11


def test_edges_of_shards(spark, odd_docs):
    placed, _ = shard_by_bytes(odd_docs, 3)
    got = placed.collect()
    assert len(got) == odd_docs.count()
    assert {r.size for r in got if r.doc_id in (3, 4)} == {16}


def test_exact_query_equals_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    groups = defaultdict(list)
    for r in docs:
        groups[lower(r.text)].append(r.doc_id)
    want = {(i, max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in op1_exact_dedup(spark, tables).collect()} == want


def test_runs_are_merged_in_order_on_their_nodes(spark, odd_docs):
    entries = exact.digests(odd_docs).select(
        (F.col("row_id") % 3).cast("int").alias("node"), *exact.ENTRY, F.struct("doc_id").alias("best"), F.lit(1).cast("long").alias("n")
    )
    run = exact._merged(entries)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(node" in plan and "HashAggregate" not in plan and "SortAggregate" in plan
    lies = run.select(F.spark_partition_id().alias("part"), "node", *exact.ENTRY, "best", "n").collect()
    places = [tuple(r)[:5] for r in lies]
    assert places == sorted(places) and sum(r.n for r in lies) == odd_docs.count()


def test_few_decisions_and_many_keep_the_same_rows(spark, odd_docs, monkeypatch):
    few = sorted(map(repr, exact.drop_exact_duplicates(odd_docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert sorted(map(repr, exact.drop_exact_duplicates(odd_docs).collect())) == few


def test_near_duplicates_leave_few_tables_and_files(spark, monkeypatch):
    handed_out = {}
    monkeypatch.setattr("runweave.storage._handed_out", handed_out)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:50], f"x{i % 3}", *words[50:]])) for i in range(40)]
    rows += [(100 + i, f"alone {i} " + " ".join(f"y{i}z{j}" for j in range(30))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    with_conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "31"}
    before = {k: spark.conf.get(k) for k in with_conf}
    for k, v in with_conf.items():
        spark.conf.set(k, v)
    try:
        found = near_duplicates(docs, 80, 3).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["component_id"] for r in found if r["doc_id"] < 100} == {0}
    assert all(r["component_id"] == r["doc_id"] for r in found if r["doc_id"] >= 100)
    left = {p.rsplit("/", 1)[-1].split("-")[0]: p for paths in handed_out.values() for p in paths}
    assert set(left) == {"sketches", "classes", "links"}
    for name in ("classes", "links"):
        assert len(spark.read.parquet(left[name]).inputFiles()) == 1


def test_plans_of_near_duplicates_stay_small(spark, monkeypatch):
    leaves = []

    def noted(df, label):
        leaves.append((label, df._jdf.queryExecution().optimizedPlan().collectLeaves().size()))
        return cut_lineage(df, label)

    for module in (common, components_module, jaccard):
        monkeypatch.setattr(module, "cut_lineage", noted)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:50], f"x{i % 3}", *words[50:]])) for i in range(40)]
    rows += [(100 + i, f"alone {i} " + " ".join(f"y{i}z{j}" for j in range(30))) for i in range(10)] + [(None, None)]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, 3)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, *range(100, 110)]
    # The driver holds each plan whole and plans it anew after every stage.
    assert {"links", "decided"} <= {label for label, _ in leaves}
    assert max(n for _, n in leaves) <= 10, leaves
