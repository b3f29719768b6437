"""Language, pieces, quality, chat: edges, brute force, held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runweave.llm import chat, language, pieces, quality
from runweave.llm.queries import op2_language_id, op3_sentencepiece, op4_chat_format, op8_quality

SAMPLE = "/root/testdata/sf0.01"


# ------------------------------------------------------------------ language


def test_languages_of_rows_never_learned_from(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}
    rows = op2_language_id(spark, SAMPLE).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 200
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, odd_docs, no_docs):
    model = language.fit(odd_docs, F.lit(True))
    got = language.identify(odd_docs, model).select("row.doc_id", "row.text", "lang_pred", "lang_score").collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r.lang_pred == "und") == (not language.words_of(r.text or ""))
    kept = language.drop_unknown(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.lang_pred != "und" for r in got)
    nothing = language.fit(no_docs, F.lit(True))
    assert language.identify(no_docs, nothing).count() == 0
    assert {r.lang_pred for r in language.identify(odd_docs, nothing).collect()} == {"und"}


def test_numbers_that_look_like_letters_are_none():
    assert [language.words_of(t) for t in ("² ½ Ⅷ ① 12 _", "m² x½", "Né 3D")] == [[], ["m²", "x½"], ["né", "d"]]


def test_marginals_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), {})
    lengths = np.array([4, 1, 3])
    scores = rng.normal(size=(lengths.sum(), 3))
    packed = language.Packed(lengths)
    marginal, moved = language.forward_backward(scores[packed.source], packed, model)
    flat = np.empty_like(marginal)
    flat[packed.source] = marginal
    want, moves, at = [], np.zeros((3, 3)), 0
    for n in lengths:
        total, node, edge = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(
                model.start[path[0]]
                + sum(scores[at + i, y] for i, y in enumerate(path))
                + sum(model.transitions[a, b] for a, b in zip(path, path[1:]))
            )
            total += weight
            for i, y in enumerate(path):
                node[i, y] += weight
            for a, b in zip(path, path[1:]):
                edge[a, b] += weight
        want.append(node / total)
        moves += edge / total
        at += n
    assert np.allclose(flat, np.concatenate(want)) and np.allclose(moved, moves)


def test_words_of_switched_text_get_their_own_language(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    model = language.fit(docs, F.lit(True))
    found = language.word_languages("that the and of with this " + "der die und von nicht mit " + "que los las una por del", model)
    assert [y for _, y in found] == ["en"] * 6 + ["de"] * 6 + ["es"] * 6


# -------------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def every_path(word, v):
    found = []

    def go(at, score, ids):
        if at == len(word):
            found.append((score, ids))
            return
        for end in range(at + 1, min(len(word), at + v.longest) + 1):
            if (piece := v.ids.get(word[at:end])) is not None:
                go(end, score + v.scores[piece], ids + [piece])
        if word[at] not in v.ids:
            go(at + 1, score + v.unknown, ids + [v.first_byte + b for b in word[at].encode()])

    go(0, 0.0, [])
    return sorted((s for s, _ in found), reverse=True)


@pytest.mark.parametrize("word", [" hello", " thblein", "  a", " 日本x", " \n\tq", " éauxtre", "▁a"])
def test_n_best_of_a_word_equals_all_paths(vocabulary, word):
    want = every_path(word, vocabulary)
    assert [s for s, _ in pieces.n_best(word, 6, vocabulary)] == want[:6]
    solved = pieces.solve([word], vocabulary)
    assert solved.scores[0] == want[0]
    assert solved.margins[0] == (want[0] - want[1] if len(want) > 1 else np.inf)


def test_n_best_of_texts_equals_all_paths(vocabulary):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c\né") for _ in range(rng.randrange(1, 11))) for _ in range(30)] + ["", " ", "▁ ▁"]
    for text, (ids, score, others) in zip(texts, pieces.encode_texts(texts, 5, pieces.Memory(vocabulary))):
        if text:
            assert [score] + [s for s, _ in others] == every_path(" " + text, vocabulary)[:5]
        for edits in [[], *[e for _, e in others]]:
            assert pieces.decode_ids(pieces.apply_edits(ids.tolist(), edits), vocabulary) == text
        assert len({tuple(pieces.apply_edits(ids.tolist(), e)) for _, e in others}) == len(others)


@pytest.mark.parametrize("word", [" ----", " aaaaa", " ......", " ====-"])
def test_ties_go_to_the_longer_last_piece(vocabulary, word):
    def bounds(ids):
        at, out = len(word), []
        for i in reversed(ids):
            at -= len(vocabulary.spelled[i].decode())
            out.append(at)
        return out

    found = pieces.n_best(word, 50, vocabulary)
    assert [s for s, _ in found] == every_path(word, vocabulary)[:50]
    assert len({tuple(ids) for _, ids in found}) == len(found)
    top = [ids for s, ids in found if s == found[0][0]]
    assert bounds(top[0]) == min(map(bounds, top))


@pytest.mark.parametrize("word", [" " + "-" * 20_000, " " + "a" * 20_000, " " + "." * 5_000, " " + "ab-." * 5_000])
def test_long_runs_of_ties_are_linear(vocabulary, word):
    found = pieces.n_best(word, 3, vocabulary)
    assert len(found) == 3 and all(pieces.decode_ids(ids, vocabulary) == word[1:] for _, ids in found)
    assert sorted((s for s, _ in found), reverse=True) == [s for s, _ in found]


def test_many_words_at_once_equal_one_at_a_time(vocabulary):
    rng = random.Random(2)
    words = [" " + "".join(rng.choice("abcdeéñ日\n") for _ in range(rng.choice([1, 5, 30, 90]))) for _ in range(200)]
    solved = pieces.solve(words, vocabulary)
    for i, word in enumerate(words):
        score, ids = pieces.n_best(word, 1, vocabulary)[0]
        own = solved.ids[solved.firsts[i] : solved.firsts[i] + solved.sizes[i]].tolist()
        assert solved.scores[i] == score and pieces.decode_ids(own, vocabulary) == word[1:]


def test_pieces_of_rows(spark, odd_docs, no_docs, vocabulary, tables):
    encoded = pieces.encode(odd_docs, vocabulary)
    rows = pieces.decode(encoded, vocabulary).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.text == (r.row.text or "") for r in rows)
    assert all(not r.ids for r in rows if not r.row.text)
    assert pieces.decode(pieces.encode(no_docs, vocabulary), vocabulary).count() == 0
    whole = op3_sentencepiece(spark, tables)
    assert whole.where("not round_trip").count() == 0 and whole.where("n_pieces <> size(ids)").count() == 0


# ------------------------------------------------------------------- quality


def test_quality_of_rows_never_learned_from(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SAMPLE}/labels.parquet").collect()}
    rows = op8_quality(spark, SAMPLE).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([labels[r.doc_id] == r.predicted for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (9, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels, F.lit(True))
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(no_docs, model).count() == 0
    empty = quality.fit(odd_docs, labels.where("false"), F.lit(True))
    assert {r.score for r in quality.score(odd_docs, empty).collect()} == {0.5}


def test_pairs_explain_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = np.zeros((4_000, len(quality.FEATURES)))
    x[:, :2] = rng.random((4_000, 2))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert model.pairs[0][:2] == (0, 1)
    assert np.mean((model.score(x) > 0.5) == y) > 0.95


def test_features_do_not_depend_on_the_batch():
    texts = [b"", "É a. a!!".encode(), b"x y\nx y\n", b" "]
    together = quality.text_features(texts)
    for i, text in enumerate(texts):
        assert np.array_equal(quality.text_features([text])[0], together[i])


# ---------------------------------------------------------------------- chat


def test_roles_of_rows_never_learned_from(spark):
    rows = op4_chat_format(spark, SAMPLE).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.role == r.role_pred for r in held]) > 0.9
    assert len(rows) == spark.read.parquet(f"{SAMPLE}/conversations.parquet").count()
    assert all(r.rendered.startswith(f"<|{r.role_pred}|>\n") and r.rendered.endswith("<|end|>\n") for r in rows)


def test_stretches_give_the_path_of_the_whole():
    rng = np.random.default_rng(1)
    seen = int(np.prod(chat.SHAPE))
    model = chat.fit_counts(["a", "b", "user"], rng.random(6) * 9, rng.random((6, 6)) * 9, rng.random((6, seen)) * 9)
    for _ in range(20):
        line = rng.integers(0, seen, 30).tolist()
        cuts = [line[:7], line[7:8], line[8:22], line[22:]]
        ends = chat.chain([chat.stretch_matrix(x, model, i == 0) for i, x in enumerate(cuts)])
        parts = [chat.solve_stretch(x, model, ends[i - 1] if i else None, ends[i]) for i, x in enumerate(cuts)]
        assert sum(parts, []) == chat.solve_stretch(line, model, None, None)
    best = max(
        itertools.product(range(6), repeat=4),
        key=lambda p: model.start[p[0]] + sum(model.emit[s, o] for s, o in zip(p, line)) + sum(model.moves[a, b] for a, b in zip(p, p[1:])),
    )
    assert list(best) == chat.solve_stretch(line[:4], model, None, None)


@pytest.mark.parametrize(
    "line,kind,rest",
    [("User: hi", 2, "hi"), ("### Assistant", 3, ""), ("**Human:** x", 2, "x"), ("<|system|>be", 1, "be"), ("A thing: x", 0, "A thing: x"), ("", 0, "")],
)
def test_markers(line, kind, rest):
    assert chat.marker_of(line) == (kind, rest)


def test_every_transition_counts_once(spark, monkeypatch):
    """Also those over borders of stretches, of the null conversation and after a null turn."""
    rng = random.Random(5)
    talks = {1: [*range(257)], 2: [None, *range(3)], None: [*range(300)], 3: [7], 4: [None]}
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["one line", "two\nlines"])) for c, turns in talks.items() for t in turns]
    starts, moves = np.zeros(4), np.zeros((4, 4))
    for conv in talks:
        line = []
        for c, _, role, text in rows:
            if c == conv:
                state = 2 * ["assistant", "user"].index(role)
                line += [state] + [state + 1] * text.count("\n")
        starts[line[0]] += 1
        for a, b in zip(line, line[1:]):
            moves[a, b] += 1
    got = []
    monkeypatch.setattr(chat, "fit_counts", lambda *found: got.append(found))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    chat.fit(chat._observed(df), F.lit(True))
    roles, found_starts, found_moves, seen = got[0]
    assert roles == ["assistant", "user"] and seen.sum() == moves.sum() + starts.sum()
    assert (found_starts == starts).all() and (found_moves == moves).all()


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, seen string, stretch int"
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "hi?" if t % 2 == 0 else "a longer answer.\n" * 9, "s", 1) for t in range(600)]
    rows += [(2, 0, None, None, None, None), (2, 0, "user", "", "s", 2), (None, None, "user", "User: hello", "s", 3), (3, 5, "user", "x", "s", 4), (3, 5, "user", "x", "s", 4)]
    chats = spark.createDataFrame(rows, schema)
    got = chat.format_chat(chats, F.lit(True)).collect()
    assert len(got) == len(rows)
    hot = sorted((r.turn, r.role, r.role_pred) for r in got if r.conv_id == 1)
    assert np.mean([a == b for _, a, b in hot]) > 0.99
    assert "<|user|>\nhello\n<|end|>\n" in {r.rendered for r in got}
    unknown = chat.format_chat(chats.where("role is null"), F.lit(True)).collect()
    assert [r.role_pred for r in unknown] == ["unknown"]
    assert chat.format_chat(spark.createDataFrame([], schema), F.lit(True)).count() == 0
