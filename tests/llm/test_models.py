"""The hidden Markov scorer, the filter audit and whitening against brute force and on odd input."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import permutations, product

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import empty, odd, odd_rows, prose
from vestige.llm import filter_audit, hmm_scoring, whitening

# --------------------------------------------------------------- hidden Markov scoring


def words_of(text: str | None) -> list[str]:
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def scores_by_hand(rows: list[tuple], scorer: hmm_scoring.Scorer) -> Counter:
    counts = Counter(w for i, t in rows if not is_held_out(i) for w in [*words_of(t), hmm_scoring.END])
    total, distinct = sum(counts.values()), len(counts)
    short = sorted((w for w in counts if w != hmm_scoring.END and len(w) <= 64), key=lambda w: (-counts[w], w))
    border = counts[short[hmm_scoring.AT_HAND]] if len(short) > hmm_scoring.AT_HAND else 0
    own = {w: k + 1 for k, w in enumerate([w for w in short if counts[w] > border][: hmm_scoring.OWN])}
    shared = lambda w: int(hmm_scoring.shared_symbols(pa.array([w]))[0])
    mass = Counter()
    for w in counts:
        if w != hmm_scoring.END and w not in own:
            mass[shared(w)] += counts[w] + 0.1
    first, moves, emissions = scorer.model
    out = Counter()
    for i, t in rows:
        tokens = [*words_of(t), hmm_scoring.END]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        score, state = 0.0, None
        for w in tokens:
            symbol = 0 if w == hmm_scoring.END else own.get(w) or shared(w)
            state = (first if state is None else state @ moves) * emissions[symbol]
            score += math.log10(state.sum()) + (math.log10((counts[w] + 0.1) / (mass[symbol] + 0.1)) if symbol > hmm_scoring.OWN else 0)
            state = state / state.sum()
        out[i, is_held_out(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6), round(score, 6)] += 1
    return out


@pytest.mark.parametrize("at_hand", [5, 1 << 16])
def test_hmm_scores_by_hand(spark, monkeypatch, at_hand):
    monkeypatch.setattr(hmm_scoring, "AT_HAND", at_hand)
    rows = odd_rows() + [(100 + k, prose(60, 50 + k)) for k in range(20)]
    scorer = hmm_scoring.Scorer(odd(spark, rows), states=3, first_rounds=1, rounds=1)
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in scorer.scored().collect())
    assert got == scores_by_hand(rows, scorer)


def test_hmm_of_no_rows_and_of_none_to_learn_from(spark):
    assert hmm_scoring.Scorer(empty(spark), states=2).scored().count() == 0
    rows = [(None, "a b"), (None, None)]
    for r in hmm_scoring.Scorer(odd(spark, rows), states=2).scored().collect():
        assert r.held_out and r.n_known == r.train_tokens == 0 and r.base_score == 0 and -50 < r.score < 0


def test_words_are_runs_between_the_six_characters():
    texts = [" a\tB\x0bc\x0c", "", "x\x1cy z\x85w", "\n\r", "É ÀÉ"]
    lengths, words = hmm_scoring.lists_of_words(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in words_of(t)] and lengths.tolist() == [len(words_of(t)) for t in texts]


def test_expected_counts_are_sums_over_all_paths():
    rng = np.random.default_rng(3)
    states, symbols = 2, hmm_scoring.SYMBOLS
    model = rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T
    texts = [rng.integers(0, 5, n) for n in (1, 4, 3, 1, 6)]
    first, moves, emissions, logs = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)), []
    for x in texts:
        paths = {}
        for path in product(range(states), repeat=len(x)):
            p = model[0][path[0]] * model[2][x[0], path[0]]
            for k in range(1, len(x)):
                p *= model[1][path[k - 1], path[k]] * model[2][x[k], path[k]]
            paths[path] = p
        logs.append(math.log10(sum(paths.values())))
        for path, p in paths.items():
            p /= sum(paths.values())
            first[path[0]] += p
            for k, s in enumerate(path):
                emissions[x[k], s] += p
                if k:
                    moves[path[k - 1], s] += p
    lengths = np.array([len(x) for x in texts])
    group = hmm_scoring.Lanes(model, np.concatenate(texts), lengths, np.float64)
    got = group.expected()
    assert np.allclose(got[0], first) and np.allclose(got[1], moves) and np.allclose(got[2], emissions)
    assert np.allclose(group.likelihoods(), logs)


def test_hmm_learns(spark):
    rows = [(k, " ".join(("un deux trois" if k % 2 else "one two three").split()[j % 3] + str(j % 2) for j in range(k % 7, 40))) for k in range(200)]
    docs = odd(spark, rows)
    losses = [[], []]
    for n, rounds in enumerate((0, 2)):
        for r in hmm_scoring.Scorer(docs, states=4, first_rounds=4 * n, rounds=rounds).scored().collect():
            losses[n].append((r.base_score, r.score))
    assert sum(s for _, s in losses[1]) > sum(s for _, s in losses[0])
    assert all(s > b for b, s in losses[1])


# ------------------------------------------------------------------------- filter audit


def audit_by_hand(rows: list[tuple], labels: list[tuple]) -> set:
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    out, parts = set(), {}
    for i, t, source in rows:
        text, words = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        smaller = any(u is not None and i is not None and u < i and (x or "") == text for u, x, _ in rows)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller]
        parts.setdefault(source or "", []).append(({x for x, f in zip("ABCDE", fails) if f}, i is not None and i in good, i is not None and i in toxic))
    for part, docs in parts.items():
        shapley, found = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, own in enumerate(order):
                gone, left = [d for d in left if own in d[0]], [d for d in left if own not in d[0]]
                redundant = sum(own in d[0] for d in docs) - len(gone)
                shapley[own] += len(gone)
                found.append((own, ("".join(order), step + 1, len(left), len(gone), redundant, sum(d[0] == {own} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out |= {(part, *row, shapley[own]) for own, row in found}
    return out


def test_filter_audit(spark):
    texts = [t for _, t in odd_rows()] + [prose(260, 9), prose(260, 9) + " $", "A" * 30 + " " + prose(220, 10)]
    rows = [(i if i != 3 else None, t, [None, "", "a", "b"][i % 4]) for i, t in enumerate(texts)] + [(0, texts[0], "a"), (0, texts[-2], "b"), (None, texts[0], "a")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 30, 2)] + [(1, 1, None), (1, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "m", b"d", True) for r in rows], "doc_id long, text string, source string, row int, mask string, digest binary, good boolean").repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    found = got.collect()
    assert len(found) == 3 * 600 and set(map(tuple, found)) == audit_by_hand(rows, labels)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


# --------------------------------------------------------------------------- whitening


def whitened_by_hand(vectors: list) -> tuple:
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return deviation, values / values.sum(), centred @ axes / np.sqrt(np.maximum(values, 1e-300))


def test_whitening_equals_the_eigenvectors(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((300, 20)) * np.linspace(1, 2, 20)).tolist()
    odd_ones = [None, [], [None] + vectors[0][1:], [math.nan] + vectors[0][1:], [math.inf] + vectors[0][1:], vectors[0][:5], [3e38] + vectors[0][1:]]
    good = [(k, v) for k, v in enumerate(vectors)] + [(7, vectors[7]), (None, vectors[8]), (7, vectors[9])]
    rows = good + [(1000 + k, v) for k, v in enumerate(odd_ones)]
    frame = spark.createDataFrame([(*r, "l", 1, 2.0) for r in rows], "vec_id long, embedding array<float>, label string, n int, x double").repartition(4)
    deviation, explained, expected = whitened_by_hand([v for _, v in good])
    got = whitening.whitened(frame).collect()
    assert len(got) == 8 * len(good) and {r.n for r in got} == {len(good)} and all(r.identity_error < 1e-9 for r in got)
    # Each row has its eight values at one place of got; one sign for each component.
    key = lambda i, d: (-1 if i is None else i, d)
    mine, by = {}, sorted(range(len(good)), key=lambda k: key(good[k][0], deviation[k]))
    for r in got:
        mine.setdefault(r.component, []).append((key(r.vec_id, r.deviation), r.whitened, r.explained))
    for c, found in mine.items():
        found.sort()
        assert [f[0] for f in found] == [key(good[k][0], deviation[k]) for k in by]
        values, other = np.array([f[1] for f in found]), expected[by, c - 1]
        assert np.allclose(values * np.sign(values @ other), other, atol=1e-7) and np.allclose([f[2] for f in found], explained[c - 1])


def test_whitening_of_few_and_equal_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).count() == 0
    flat = whitening.whitened(spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(5)], schema)).collect()
    assert len(flat) == 5 and all(r.component == 1 and abs(r.explained - 1) < 1e-9 for r in flat)


def test_lobpcg_certifies_equal_and_close_eigenvalues():
    rng = np.random.default_rng(4)
    axes = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    for values in (np.r_[np.full(4, 5.0), np.linspace(1, 0, 86)], 1 + np.arange(90) * 1e-4, np.r_[3.0, 2.0, np.zeros(88)]):
        matrix = axes * values @ axes.T
        found, vectors, worst = whitening.lobpcg(lambda block, m=matrix: m @ block, 90, 6)
        assert np.allclose(found, np.sort(values)[::-1][:6], rtol=0, atol=1e-11)
        assert np.abs(matrix @ vectors - vectors * found).max() < 1e-10 and worst < 1e-10
        assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-12


def test_exact_deviations_beyond_longs():
    column = pa.array([[1 << 40, 5], [3, 1 << 41]], pa.list_(pa.int64()))
    sums = np.array([(1 << 40) + 3, (1 << 41) + 5], object)
    assert whitening.centred(column, 1 << 30, sums).tolist() == [[(1 << 70) - sums[0], (5 << 30) - sums[1]], [(3 << 30) - sums[0], (1 << 71) - sums[1]]]
