import math
import random

import numpy as np
import xxhash
from folioframe.llm import simhash as S
from folioframe.llm.components import connected_components

from .helpers import awkward, clashing, doc, frame, prose


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(fps, limit=4):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= limit and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def brute_components(rows, limit=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_labels(fps, limit)
    ids = {}
    for (doc_id, _), c in zip(rows, label):
        ids.setdefault(c, []).append(doc_id)
    return [(doc_id, f"{fp:016x}", min((i for i in ids[c] if i is not None), default=None)) for (doc_id, _), fp, c in zip(rows, fps, label)]


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    rows = awkward()
    for g in range(25):
        words = prose(50 + g, 300).split()
        for k in range(8):
            copy = words[:]
            for _ in range(k % 4):
                copy[rng.randrange(len(copy))] = "Changed"
            rows.append(doc(100 + 10 * g + k, " ".join(copy)))
    found = S.near_duplicates(clashing(frame(spark, rows))).collect()
    key = lambda x: str(tuple(x))
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in found], key=key) == sorted(brute_components([r[:2] for r in rows]), key=key)
    assert len({r.component_id for r in found}) < len(rows) - 80
    assert S.near_duplicates(frame(spark, [])).count() == 0
    # beyond the broadcast bound all joins shuffle
    shuffled = S.near_duplicates(frame(spark, rows), rows=0).collect()
    assert sorted(map(tuple, shuffled), key=str) == sorted(map(tuple, found), key=str)


def test_one_row_of_each_component_stays(spark):
    words = prose(77, 200).split()
    near = " ".join(words[:100] + ["Changed"] + words[101:])
    rows = awkward() + [doc(50, " ".join(words)), doc(None, near), doc(None, " ".join(words)), doc(51, near), doc(8, prose(30, 90)), doc(None, prose(31, 90)), doc(None, prose(31, 90), "de")]
    assert bin(brute_fingerprint(near) ^ brute_fingerprint(" ".join(words))).count("1") <= 4
    docs = clashing(frame(spark, rows))
    for most in (S.BROADCAST_ROWS, 0):
        kept = S.keep_one(docs, rows=most)
        assert kept.columns == docs.columns
        out = kept.collect()
        labels = brute_labels([brute_fingerprint(r[1]) for r in rows])
        best = {}
        for place, (r, label) in enumerate(zip(rows, labels)):
            best[label] = min(best.get(label, (True, 0, place)), (r[0] is None, r[0] or 0, place))
        # which of two rows of equal id and text stays can't be told
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == sorted((none, i, rows[place][1] or "") for none, i, place in best.values())
        assert sum(r.doc_id is None for r in out) == 2 and sum(r.doc_id == 8 for r in out) == 2
    assert S.keep_one(frame(spark, [])).count() == 0


def test_thresholds_meet_the_general_pigeonhole_bound():
    rng = np.random.default_rng(1)
    for n, spread in ((1000, 0.5), (10**6, 0.1), (10**10, 0.5), (10**8, 0.02)):
        share = np.clip(rng.normal(0.5, spread, 64), 0.01, 0.99)
        together = np.outer(share, share) * n
        np.fill_diagonal(together, share * n)
        chosen = S.plan(n, together)
        assert sum(t + 1 for _, t in chosen) == 5
        bits = [b for own, _ in chosen for b in own]
        assert len(bits) == len(set(bits))


def test_more_documents_take_finer_probes():
    even = lambda n: np.where(np.eye(64) > 0, 0.5, 0.25) * n
    assert max(len(b) for b, _ in S.plan(10**10, even(10**10))) > max(len(b) for b, _ in S.plan(10**5, even(10**5)))


def test_every_plan_finds_every_link(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), k)) for c in centres for k in (0, 1, 2, 3, 4, 4, 5) for _ in range(3)}
    fps = np.array(sorted(values), np.uint64)
    nodes = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    near = {(a, b) for i, a in enumerate(fps.tolist()) for b in fps[i + 1 :].tolist() if (a ^ b).bit_count() <= 4}
    groups = [list(range(0, 16)), list(range(16, 32)), list(range(32, 48)), list(range(48, 64))]
    halves = [list(range(0, 64, 2)), list(range(1, 64, 2))]
    for chosen in ([(groups[0], 1), (groups[1], 0), (groups[2], 0), (groups[3], 0)], [(halves[0], 2), (halves[1], 1)], [(groups[0] + groups[1], 1), (groups[2], 1), (groups[3], 0)]):
        links = S.verified_links(S.probes(nodes, chosen)).collect()
        parent = {int(v): int(v) for v in fps}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in links:
            a, b = r.a % (1 << 64), r.b % (1 << 64)
            assert (a ^ b).bit_count() <= 4
            parent[find(a)] = find(b)
        assert all(find(a) == find(b) for a, b in near)
        # buckets cut again by their other bits lose no link either
        cut = S.verified_links(S.cut_buckets(nodes, S.probes(nodes, chosen), chosen, 4, most=2)).collect()
        whole = connected_components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long")).collect()
        again = connected_components(spark.createDataFrame([(r.a, r.b) for r in cut], "a long, b long")).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, whole))


def test_expected_pairs_follow_correlated_bits():
    rng = np.random.default_rng(5)
    topics = rng.integers(0, 1 << 16, 60)
    values = topics[rng.integers(0, 60, 1500)] ^ (1 << rng.integers(0, 16, 1500))
    bits = (values[:, None] >> np.arange(64)) & 1
    together = (bits.T @ bits).astype(np.int64)
    n = len(values)
    own = list(range(16))
    differ = (bits[:, None, :16] != bits[None, :, :16]).sum(axis=2)
    for t in (0, 1, 2, 3):
        real = float((differ <= t).sum())
        independent = n * n * 2.0**-16 * sum(math.comb(16, k) for k in range(t + 1))
        found = S.expected_pairs(n, together, own, 4)[t]
        assert abs(math.log(found / real)) < abs(math.log(independent / real))


def test_a_probe_that_joins_two_own_rows_is_not_lost(spark):
    # s1 - o2 - s2 - o1: neighbours differ in one bit of each group, so they meet in the first group alone, at threshold 1
    flip = lambda k: 1 | sum(1 << g + k for g in (16, 32, 48))
    s1 = 1 << 50
    o2 = s1 ^ flip(0)
    s2 = o2 ^ flip(1)
    o1 = s2 ^ flip(2)
    assert s1 < s2 and o1 < o2 and min((s1 ^ s2).bit_count(), (o1 ^ o2).bit_count(), (s1 ^ o1).bit_count()) > 4
    nodes = spark.createDataFrame([(v,) for v in (s1, s2, o1, o2)], "fp long")
    chosen = [(list(range(g, g + 16)), int(g == 0)) for g in (0, 16, 32, 48)]
    links = {frozenset((r.a, r.b)) for r in S.verified_links(S.probes(nodes, chosen)).collect()}
    assert links == {frozenset(p) for p in ((s1, o2), (o2, s2), (s2, o1))}


def test_trees_of_a_bucket_join_all_that_own_rows_reach():
    rng = random.Random(4)
    for _ in range(200):
        values = list({sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5))) << 1 | rng.randint(0, 1) for _ in range(rng.randint(2, 40))})
        n = rng.randint(1, len(values))
        label = {v: v for v in values}
        want = [(a, b) for i, a in enumerate(values[:n]) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2]
        found = [(a, b) for x, y in S.links_in_bucket(np.array(values[:n], np.uint64), np.array(values[n:], np.uint64), 2) for a, b in zip(x.tolist(), y.tolist())]
        assert set(map(frozenset, found)) <= set(map(frozenset, want)) and len(found) < len(values)
        for a, b in found:
            old, new = label[a], label[b]
            label = {v: new if c == old else c for v, c in label.items()}
        assert all(label[a] == label[b] for a, b in want)


def test_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5), (None, 3), (5000, 1050)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), rows=0, least=3).collect()} == found
    assert all(found[i] == 0 for i in range(201))
    assert all(found[1000 + i] == 1000 for i in range(100)) and found[5000] == 1000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
