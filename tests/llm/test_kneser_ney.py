import math
import zlib
from collections import Counter

import folioframe.llm.kneser_ney as K
import numpy as np
import pytest

from .helpers import awkward, clashing, doc, frame, prose


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).replace(" ", "\x00").split("\x00")


def words(text):
    return [w for w in tokens(text) if w] + [""]


class Brute:
    """The model in dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for text in texts:
            before = None
            for w in words(text):
                self.uni[w] += 1
                self.bi[before, w] += 1
                before = w
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.seen = Counter(w for _, w in self.bi)
        self.d, self.low = self._discounts(self.bi), self._discounts(self.seen)
        self.total, self.rest = Counter(), Counter()
        for (u, _), c in self.bi.items():
            self.total[u] += c
            self.rest[u] += self.d[min(c, 3)]

    @staticmethod
    def _discounts(counts):
        n = Counter(counts.values())
        return K.discounts(n[1], n[2], n[3], n[4])

    def lower(self, w):
        rest = sum(self.low[min(c, 3)] for c in self.seen.values()) / len(self.bi)
        return max(self.seen[w] - self.low[min(self.seen[w], 3)], 0) / len(self.bi) + rest / (self.v + 1)

    def chance(self, u, w):
        if not self.total[u]:
            return self.lower(w)
        c = self.bi[u, w]
        return max(c - self.d[min(c, 3)], 0) / self.total[u] + self.rest[u] / self.total[u] * self.lower(w)

    def score(self, text):
        w = words(text)
        return sum(math.log10(self.chance(a, b)) for a, b in zip([None, *w], w))


class Brute3:
    """The trigram model in dictionaries: bigrams count their contexts, but those that begin a text."""

    def __init__(self, texts):
        self.uni, self.tri, begins = Counter(), Counter(), Counter()
        for text in texts:
            w = [None, *words(text)]
            self.uni.update(w[1:])
            begins[None, w[1]] += 1
            self.tri.update(zip(w, w[1:], w[2:]))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.bi = Counter((b, c) for _, b, c in self.tri) + begins
        self.seen = Counter(w for _, w in self.bi)
        self.d3, self.d2, self.d1 = (Brute._discounts(c) for c in (self.tri, self.bi, self.seen))
        self.total, self.rest = Counter(), Counter()
        for grams, d in ((self.tri, self.d3), (self.bi, self.d2)):
            for g, c in grams.items():
                self.total[g[:-1]] += c
                self.rest[g[:-1]] += d[min(c, 3)]

    def chance(self, a, b, w):
        total = sum(self.seen.values())
        p = max(self.seen[w] - self.d1[min(self.seen[w], 3)], 0) / total + sum(self.d1[min(c, 3)] for c in self.seen.values()) / total / (self.v + 1)
        for context, c, d in (((b,), self.bi[b, w], self.d2), ((a, b), self.tri[a, b, w], self.d3)):
            if a == "" and len(context) == 2:  # nothing stands before the start of text
                continue
            if self.total[context]:
                p = max(c - d[min(c, 3)], 0) / self.total[context] + self.rest[context] / self.total[context] * p
        return p

    def score(self, text):
        w = ["", None, *words(text)]
        return sum(math.log10(self.chance(*g)) for g in zip(w, w[1:], w[2:]))


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("sizes", [{}, {"range_tokens": 300, "part_words": 20}])
def test_scores_against_brute_force(spark, monkeypatch, sizes, order):
    monkeypatch.setattr(K, "CHUNK", 500 if sizes else K.CHUNK)
    rows = [doc(1000 + i, prose(i, 10 + i % 60)) for i in range(150)] + awkward()[:6] + [doc(900, "hot cold " * 300), doc(901, "new words ÀÉ only here"), doc(902, "The OF And")]
    learned = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    brute = (Brute if order == 2 else Brute3)([r[1] for r in learned])
    model = K.train(frame(spark, rows).filter(K.training(5, 1)), order, **sizes)
    assert (model.tokens, model.vocabulary) == (brute.n, brute.v)
    found = K.score_texts(clashing(frame(spark, rows)), model).collect()
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        w = words(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in brute.uni for x in w), brute.n)
        assert math.isclose(r.score, brute.score(texts[r.doc_id]), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((brute.uni[x] + 0.5) / (brute.n + 0.5 * (brute.v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    brute = Brute([prose(i, 40) for i in range(30)])
    for u in (None, "the", "river", "unheard"):
        assert math.isclose(sum(brute.chance(u, w) for w in brute.uni) + brute.chance(u, "never seen"), 1.0, rel_tol=1e-9)


def test_probabilities_of_trigrams_sum_to_one():
    brute = Brute3([prose(i, 40) for i in range(30)])
    for a, b in (("", None), (None, "the"), ("the", "river"), ("unheard", "of"), ("of", "unheard")):
        assert math.isclose(sum(brute.chance(a, b, w) for w in brute.uni) + brute.chance(a, b, "never seen"), 1.0, rel_tol=1e-9)


def test_orders_and_vocabularies_that_cannot_be_counted(spark, monkeypatch):
    assert (K.MOST_WORDS + 1) ** 2 < 1 << 63 <= (K.MOST_WORDS + 2) ** 2
    with pytest.raises(ValueError):
        K.train(frame(spark), order=4)
    monkeypatch.setattr(K, "MOST_WORDS", 5)
    with pytest.raises(OverflowError):
        K.train(frame(spark))


def test_pairs_that_fit_no_integer():
    rng = np.random.default_rng(1)
    context, word = rng.integers(0, 9, 500), rng.integers(0, 9, 500)
    small = K.distinct_pairs(context, word, None, 9)
    large = K.distinct_pairs(context + (1 << 62), word, np.full(500, 2), 9)
    assert small[0].tolist() == (large[0] - (1 << 62)).tolist() and small[1].tolist() == large[1].tolist() and (2 * small[2]).tolist() == large[2].tolist()
    assert dict(zip(zip(*map(np.ndarray.tolist, small[:2])), small[2].tolist())) == Counter(zip(context.tolist(), word.tolist()))


def test_held_out_texts_are_predicted_better_than_by_single_words(spark):
    rows = [doc(i, " ".join(w for _ in range(20) for w in (["silver", "river"] if (i + _) % 2 else ["copper", "coin"]))) for i in range(200)]
    out = [r for r in K.score_held_out(frame(spark, rows)).collect() if r.held_out]
    assert out and all(r.score > r.base_score / 1.5 for r in out)
    assert {r.doc_id for r in out} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1}


def test_awkward_rows(spark):
    out = K.score_held_out(frame(spark)).collect()
    assert len(out) == len(awkward()) and all(np.isfinite([r.score, r.base_score]).all() for r in out)
    assert K.score_held_out(frame(spark, [])).count() == 0 and K.score_held_out(frame(spark, []), order=3).count() == 0
    only = [doc(i, "a b") for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1]
    unlearned = K.score_held_out(frame(spark, only)).collect()
    assert {(r.n_known, r.train_tokens, r.score, r.base_score) for r in unlearned} == {(0, 0, 0.0, 0.0)}


def test_runs_pack_and_unpack():
    values = np.array([0, 0, 3, 3, 1 << 40, (1 << 62) + 5], np.int64)
    assert K.unpacked(K.packed(values)).astype(np.int64).tolist() == values.tolist()
    assert K.unpacked_values(K.packed_values(values[::-1])).tolist() == values[::-1].tolist()
