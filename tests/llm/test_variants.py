"""Spelling variants, resampling, byte-level BPE: brute force and edges."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex

from runweave.llm import byte_bpe, resampling, spelling
from runweave.llm.queries import BYTE_RANKS, op13_byte_bpe

# ------------------------------------------------------------------ spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, modulus, least_length, least_n):
    total = Counter()
    for doc_id, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least_n}


def brute_groups(words, times=2):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return rows


@pytest.mark.parametrize("parts,leaf", [(50_000, 48), (40, 5)])
def test_near_words_equal_all_pairs(spark, monkeypatch, parts, leaf):
    rng = random.Random(parts)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(400)}
    # Anagrams of one another, and long words.
    words |= {"".join(p) for p in itertools.islice(itertools.permutations("abcdefg"), 120)} | {"x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149}
    monkeypatch.setattr(spelling, "PART_WORDS", parts)
    monkeypatch.setattr(spelling, "CELL_WORDS", 60)
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
    monkeypatch.setattr(spelling, "SAMPLE_WORDS", 200)
    numbers = {w: i for i, w in enumerate(sorted(words))}
    found = spelling.near_words(spark.createDataFrame(list(numbers.items()), "word string, n long")).collect()
    want = {(a, b, numbers[b]) for a in words for b in words if one_edit(a, b)}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("aeT") for _ in range(rng.randrange(3, 8))) for _ in range(60))) for i in range(80)]
    rows += [(None, "Straße STRASSE straße Éclair éclair × ÷"), (7, None), (8, ""), (8, "straße " * 9), (None, "straße")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.spelling_groups(docs, modulus=5).collect()
    assert {tuple(r) for r in got} == brute_groups(brute_words(rows, 5, 5, 3)) and len({r.word for r in got}) == len(got)


def test_forms_are_followed_to_the_end(spark):
    forms = [(f"w{i:02}", f"w{i + 1:02}") for i in range(21)] + [("lone", "w05")]
    got = spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert {r.root for r in got} == {"w21"} and len(got) == 22


def test_spelling_edges(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = {tuple(r) for r in spelling.spelling_groups(odd_docs).collect()}
    assert got == brute_groups(brute_words(rows, 97, 5, 3))
    assert spelling.spelling_groups(no_docs).count() == 0


# ---------------------------------------------------------------- resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text, n_max):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, n_max + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("piece", [1 << 19, 40])
def test_payloads_compose_to_the_checksums_of_features(monkeypatch, piece):
    monkeypatch.setattr(resampling, "SLICE", piece)
    rng = random.Random(piece)
    texts = ["".join(rng.choice("aB9é日 -\n") for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    texts += ["", " ", "a" * 700 + " b " + "a" * 700, "tail"]
    owner, bucket, words = resampling.features([t.encode() for t in texts], 3, 1 << 32)
    for i, text in enumerate(texts):
        own, wanted = brute_features(text, 3)
        assert words[i] == len(own)
        assert sorted(bucket[owner == i].tolist()) == sorted(zlib.crc32(f.encode()) for f in wanted)


def brute_resample(docs, target, percent, seed, n_max, buckets, least_words):
    held = [brute_features(text, n_max) for _, text in docs]
    s, t = Counter(), Counter()
    for _, found in held:
        s.update(zlib.crc32(f.encode()) % buckets for f in found)
    for text in target:
        t.update(zlib.crc32(f.encode()) % buckets for f in brute_features(text, n_max)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for (doc_id, _), (words, found) in zip(docs, held):
        of = [zlib.crc32(f.encode()) % buckets for f in found]
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in of)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(words), len(of), weight, score))
    fit = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(fit) // 100
    return Counter([(*r, i + 1 if i < drawn else None) for i, r in enumerate(fit)] + [(*r, None) for r in rows if r[1] < least_words])


def test_resampling_equals_brute_force(spark, odd_docs, no_docs, tables):
    items = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()] + [None, ""]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    docs = odd_docs.unionByName(spark.read.parquet(f"{tables}/documents.parquet"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for arguments in ((10, 2024, 1, 10_000, 20), (35, 1, 3, 97, 0)):
        got = Counter(tuple(r) for r in resampling.resample(docs, target, *arguments).collect())
        assert got == brute_resample(rows, items, *arguments)
    assert resampling.resample(no_docs, target, 10, 1).count() == 0
    assert {r.weight for r in resampling.resample(docs, no_docs, 0, 1).where("n_features = 0").collect()} == {0}


# ------------------------------------------------------------------ byte BPE


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load(public_tokenizers.path(BYTE_RANKS))


def match_by_match(text, encoding):
    pattern = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return [i for m in regex.finditer(pattern, text) for i in encoding._encode_single_piece(m[0])]


def test_parts_have_the_matches_of_the_whole(ranks, monkeypatch):
    encoding = byte_bpe.tokenizer(ranks, public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "PART", 12)
    monkeypatch.setattr(byte_bpe, "LONG_SPACE", 3)
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", "7", " ", "   ", "\n", "\t  ", "'s", "'", "-", "日", "\x1c", "\xa0", "<|endoftext|>"]) for _ in range(40))
        assert "".join(part for _, part in byte_bpe.parts_of(text)) == text
        whole = encoding.encode_ordinary(text)
        assert byte_bpe.encode_text(text, encoding).tolist() == whole == match_by_match(text, encoding)
        assert encoding.decode_bytes(whole) == text.encode()


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + " \n" * 300_000 + "b", "x" * 500_000, "- " * 100_000, "日" * 100_000])
def test_long_texts(ranks, text):
    encoding = byte_bpe.tokenizer(ranks, public_tokenizers.PATTERN)
    assert encoding.decode_bytes(byte_bpe.encode_text(text, encoding).tolist()) == text.encode()


def test_tokens_of_rows(spark, odd_docs, no_docs, ranks, tables):
    encoded = byte_bpe.encode(odd_docs, ranks, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(encoded, ranks).collect()
    assert len(rows) == odd_docs.count()
    assert all(bytes(r.decoded) == (r.row.text or "").encode() for r in rows)
    assert all(not r.ids for r in rows if not r.row.text)
    assert byte_bpe.decode(byte_bpe.encode(no_docs, ranks, public_tokenizers.PATTERN), ranks).count() == 0
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(nothing, ranks).collect()] == [b"", b""]
    encoding = byte_bpe.tokenizer(ranks, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    for r in op13_byte_bpe(spark, tables).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
