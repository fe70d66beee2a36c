import zlib
from collections import defaultdict

import pytest
from folioframe.llm.common import materialise
from folioframe.llm.sharding import _unsigned, find_splitters, keyed, shard_documents

from .helpers import awkward, clashing, doc, frame, prose


def shards_of(rows):
    found = defaultdict(list)
    for r in rows:
        found[r.shard].append(r)
    return found


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    for own in shards_of(rows).values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert all(0 <= r.shard < shards for r in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)


def test_sizes_are_near_equal_and_copies_stay_together(spark):
    docs = [doc(i, prose(i % 700, 20 + i % 50)) for i in range(1500)]
    rows = shard_documents(frame(spark, docs), 8, 0.01).collect()
    check(rows, [d[:2] for d in docs], 8)
    sizes = [sum(r.size for r in own) for own in shards_of(rows).values()]
    assert len(sizes) == 8 and max(sizes) < 1.06 * sum(sizes) / 8 and min(sizes) > 0.94 * sum(sizes) / 8
    homes = defaultdict(set)
    for r in rows:
        homes[r.text_crc32].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 7


def test_a_hot_group_is_cut(spark):
    docs = [doc(i, prose(0, 60)) for i in range(600)] + [doc(1000 + i, prose(1 + i, 60)) for i in range(600)]
    rows = shard_documents(frame(spark, docs), 6, 0.01).collect()
    check(rows, [d[:2] for d in docs], 6)
    sizes = [sum(r.size for r in own) for own in shards_of(rows).values()]
    assert max(sizes) < 1.05 * sum(sizes) / 6


def test_many_ranges_give_the_same_shards(spark):
    docs = frame(spark, [doc(i, prose(i, 30)) for i in range(400)])
    one = shard_documents(docs, 4, 0.02).collect()
    many = shard_documents(docs, 4, 0.02, range_bytes=2000).collect()
    check(many, [(r.doc_id, prose(r.doc_id, 30)) for r in many], 4)
    sizes = [sum(r.size for r in own) for own in shards_of(many).values()]
    assert max(sizes) < 1.1 * sum(sizes) / 4
    same = {r.doc_id: r.shard for r in one}
    assert sum(same[r.doc_id] != r.shard for r in many) < 40


def test_order_is_by_key(spark):
    rows = shard_documents(frame(spark, [doc(i, prose(i % 50, 30)) for i in range(300)]), 3).orderBy("shard", "slot").collect()
    seen, last = set(), None
    for r in rows:
        if r.text_crc32 != last:
            assert r.text_crc32 not in seen
            seen.add(r.text_crc32)
            last = r.text_crc32


def test_awkward_rows(spark):
    rows = shard_documents(clashing(frame(spark)), 4, keep=("text", "lang")).collect()
    check(rows, [r[:2] for r in awkward()], 4)
    assert {r.text for r in rows} == {r[1] for r in awkward()}
    assert shard_documents(frame(spark, []), 4).count() == 0
    long = [doc(1, "x" * 300000), *(doc(i, prose(i, 20)) for i in range(2, 60))]
    check(shard_documents(frame(spark, long), 4).collect(), [d[:2] for d in long], 4)


@pytest.mark.parametrize("rows", [[doc(1, "the same")] * 800, [doc(None, "x " * 50)] * 800, [doc(None, None)] * 400, [doc(3, "a")] * 300 + [doc(None, prose(5, 40))] * 700 + [doc(i, prose(i, 40)) for i in range(300)]])
def test_equal_rows_are_cut_like_others(spark, rows):
    out = shard_documents(frame(spark, rows), 16, 0.01).collect()
    check(out, [r[:2] for r in rows], 16)
    sizes = [sum(r.size for r in own) for own in shards_of(out).values()]
    largest = max(r.size for r in out)
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * (0.01 * sum(sizes) / 16 + largest)


def brute_splitters(keys, shards):
    """For each target the two boundaries between sorted keys that enclose it, as bytes and rows below."""
    ordered = sorted(keys)
    total = sum(size for *_, size in ordered)
    below, n, places = 0, 0, [(0, 0)]
    for *_, size in ordered:
        below, n = below + size, n + 1
        places.append((below, n))
    out = []
    for i in range(1, shards):
        aim = total * i / shards
        out.append((max(p for p in places if p[0] <= aim), min(p for p in places if p[0] >= aim)))
    return total, places, out


@pytest.mark.parametrize("rows", [[doc(i, prose(i % 90, 5 + i % 60)) for i in range(400)], [doc(i % 3, "copy of a copy") for i in range(300)] + [doc(None, prose(i, 300)) for i in range(9)]])
def test_splitters_against_brute_force(spark, rows):
    keys = materialise(keyed(frame(spark, rows)), "keys")
    found = find_splitters(keys, 7, 0.02, 1 << 30, 64)
    plain = [tuple(_unsigned(k) for k in (r.k1, r.k2, r.k3)) + (r.size,) for r in keys.collect()]
    total, places, around = brute_splitters(plain, 7)
    for bound, n, (low, high) in zip(found.bounds, found.rows_below, around):
        mine = [k for k in plain if k[:3] < bound]
        assert len(mine) == n  # the counts are those of the boundary
        below = sum(k[3] for k in mine)
        assert (below, n) in places  # the boundary lies between keys
        aim = total * (found.bounds.index(bound) + 1) / 7
        assert abs(below - aim) <= max(0.02 * total / 7, min(aim - low[0], high[0] - aim))
