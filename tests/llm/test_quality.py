import math
import random

import numpy as np
import pytest
from folioframe.llm import quality as Q

from .helpers import clashing, doc, frame, prose


def brute_statistics(text):
    text = text or ""
    space = set(" \t\n\x0b\x0c\r")
    words, now = [], ""
    for c in text + " ":
        if c in space:
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if any(c not in space for c in line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(line in lines[:i] for i, line in enumerate(lines)), len(covered), len(lines))


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "a b c d e a b c d e", "a b c d e f a b c d e f g", "x y\nx y\n\n \nx y", "é\x0b| <b> & #", "w " * 30, "one two three four five six " * 2 + "end"])
def test_statistics_against_brute_force(text):
    assert Q.statistics(text) == brute_statistics(text)


def test_statistics_on_random_texts():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "c", " ", " ", "\n", "|", "é "]) for _ in range(rng.randint(0, 80)))
        assert Q.statistics(text) == brute_statistics(text)


def test_chi_square():
    assert math.isclose(Q.chi_square_quantile(0.95, 5), 11.0705, abs_tol=1e-3)
    assert math.isclose(Q.chi_square_cdf(11.0705, 5), 0.95, abs_tol=1e-4)


def brute_mcd(rows, share=0.75, steps=5):
    """The same estimate for one group, from plain arrays: starts, concentration, reweighting, distances of all rows."""
    x = np.array(sorted(set(rows)))
    n, p = x.shape

    def moments(part, factor):
        mean = part.mean(axis=0)
        return mean, Q._inverse(factor * (part.T @ part / len(part) - np.outer(mean, mean)))

    centre, scale = [], []
    for i in range(p):
        bins = np.sort(np.floor(x[:, i] / Q.STEP))
        at = [(bins[math.ceil(s * n) - 1] + 0.5) * Q.STEP for s in (0.25, 0.5, 0.75)]
        centre.append(at[1])
        scale.append(max((at[2] - at[0]) / 1.349, Q.FLOORS[i]))
    z = (x - centre) / scale
    shapes = [np.eye(p)]
    for y in (np.tanh(z), z / np.sqrt((z**2).sum(axis=1) + 1e-9)[:, None]):
        s = y.T @ y
        d = np.sqrt(np.outer(s.diagonal(), s.diagonal()))
        r = np.where(d > 0, s / np.where(d > 0, d, 1) * 0.95, 0)
        np.fill_diagonal(r, 1)
        shapes.append(r)
    best = None
    for s, shape in enumerate(shapes):
        now = np.array(centre), Q._inverse(shape * np.outer(scale, scale))
        for _ in range(steps):
            d = np.einsum("ij,jk,ik->i", x - now[0], now[1][0], x - now[0])
            bins = np.floor(Q.BINS * np.log(np.maximum(d, 0) + 1e-9))
            limit = np.sort(bins)[math.ceil(share * n) - 1]
            now = moments(x[bins <= limit], 1.0)
        if best is None or now[1][1] < best[1][1]:
            best = now
    d = np.einsum("ij,jk,ik->i", x - best[0], best[1][0], x - best[0])
    mean, (inverse, _) = moments(x[d <= Q.chi_square_quantile(0.975, p) * Q._consistency(share)], Q._consistency(0.975))
    every = np.array(rows)
    return np.einsum("ij,jk,ik->i", every - mean, inverse, every - mean)


def test_distances_against_brute_force(spark):
    rng = random.Random(2)
    rows = [doc(i, prose(i, rng.randint(20, 300)) + (" |" * rng.randint(0, 6) if i % 3 == 0 else ""), rng.choice(["en", "de"]), "s") for i in range(300)]
    rows += [doc(1000 + i, "% | # " * (30 + i), "en", "s") for i in range(3)] + rows[:20]
    out = {}
    for row in Q.judge(frame(spark, rows)).collect():
        out[row.doc_id] = row
    assert len(out) == 303
    for lang in ("en", "de"):
        own = [r for r in rows if r[2] == lang]
        stats = [brute_statistics(r[1]) for r in own]
        ok = [i for i, s in enumerate(stats) if s[0] >= 10 and 100 * s[4] <= 20 * s[0]]
        vectors = [tuple(round(v, 9) for v in (math.log(s[0]), math.log(s[1] / s[0]), math.sqrt(s[2] / s[0]), math.sqrt(s[3] / s[5]), math.sqrt(s[4] / s[0]))) for s in (stats[i] for i in ok)]
        for i, expected in zip(ok, brute_mcd(vectors)):
            found = out[own[i][0]]
            assert math.isclose(found.distance, expected, rel_tol=1e-5, abs_tol=1e-6)
            assert found.kept == (expected <= Q.chi_square_quantile(1 - 1e-9, Q.P))
    assert not any(out[1000 + i].kept for i in range(3))


def test_copies_cannot_take_over(spark):
    rng = random.Random(4)
    rows = [doc(i, prose(i, rng.randint(40, 200))) for i in range(120)] + [doc(1000 + i, prose(999, 150)) for i in range(400)]
    rows += [doc(5000, " ".join(f"<{w}>#%" for w in prose(1, 60).split()))]
    kept = {r.doc_id: r.kept for r in Q.judge(frame(spark, rows)).collect()}
    assert sum(kept[i] for i in range(120)) == 120 and kept[1000] and not kept[5000]


def test_small_groups_are_judged_by_their_language_then_by_all(spark):
    junk = lambda seed: " ".join(f"<{w}>#%" for w in prose(seed, 60).split())
    rows = [doc(i, prose(i, 40 + i), "en", "large") for i in range(120)]
    rows += [doc(200 + i, prose(200 + i, 60 + i), "en", f"small{i}") for i in range(8)] + [doc(300, junk(1), "en", "small0"), doc(301, junk(2), "en", "alone")]
    rows += [doc(400, prose(400, 70), "de", "large"), doc(401, junk(3), "de", "large"), doc(402, junk(4), None, None)]
    out = {r.doc_id: r for r in Q.judge(frame(spark, rows)).collect()}
    assert all((r.distance is None) == r.base_failed for r in out.values())
    assert {i for i, r in out.items() if not r.kept} == {300, 301, 401, 402}
    english = brute_mcd([vector(r[1]) for r in rows if r[2] == "en"])
    found = [out[r[0]].distance for r in rows if r[2] == "en" and r[3] != "large"]
    assert np.allclose(found, english[120:], rtol=1e-5, atol=1e-6)
    everything = brute_mcd([vector(r[1]) for r in rows])
    assert np.allclose([out[i].distance for i in (400, 401, 402)], everything[-3:], rtol=1e-5, atol=1e-6)


def vector(text):
    s = brute_statistics(text)
    return tuple(round(v, 9) for v in (math.log(s[0]), math.log(s[1] / s[0]), math.sqrt(s[2] / s[0]), math.sqrt(s[3] / s[5]), math.sqrt(s[4] / s[0])))


def test_a_table_of_few_vectors_gives_distances(spark):
    rows = [doc(i, prose(i, 40 + i), "en", f"s{i}") for i in range(40)] + [doc(100, " ".join(f"<{w}>#%|" for w in prose(1, 60).split()), "en", "s100")]
    out = {r.doc_id: r for r in Q.judge(frame(spark, rows)).collect()}
    assert all(r.distance is not None for r in out.values()) and {i for i, r in out.items() if not r.kept} == {100}
    one = Q.judge(frame(spark, rows[:1])).collect()
    assert one[0].kept and one[0].distance is not None


def test_small_sample_cutoff():
    assert Q.small_sample_cutoff(5, 1e-9) == math.inf
    # five times the F quantile 3.3258 (0.95; 5, 10) times 224 / 150
    assert math.isclose(Q.small_sample_cutoff(15, 0.05), 5 * 3.3258 * 224 / 150, rel_tol=1e-4)
    assert math.isclose(Q.small_sample_cutoff(1000, 0.05), Q.chi_square_quantile(0.95, 5), rel_tol=0.02)


def test_awkward_rows(spark):
    out = {r.doc_id: r for r in Q.judge(clashing(frame(spark))).collect()}
    assert Q.judge(frame(spark)).count() == 12
    assert not any(out[i].kept for i in (4, 5, 6, 10)) and out[4].n_words == 0
    assert out[9].kept and out[None].kept  # groups too small for an estimate
    assert Q.judge(frame(spark, [])).count() == 0
