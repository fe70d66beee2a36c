import random

import folioframe.llm.decontaminate as D
import pytest

from .helpers import awkward, clashing, doc, frame, prose

ITEMS = "item_id long, text string"


def brute(docs, items, percent=80):
    out = set()
    for item_id, text in items:
        words = D.words_of(text)
        if not words:
            continue
        width = min(5, len(words))
        own = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        for doc_id, body in docs:
            w = D.words_of(body)
            common = len(own & {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
            if 100 * common >= percent * len(own):
                out.add((doc_id, item_id, len(own), common))
    return out


@pytest.mark.parametrize("block_bytes, pass_bytes", [(8 << 20, 32 << 20), (300, 1000)])
def test_against_brute_force(spark, block_bytes, pass_bytes):
    rng = random.Random(1)
    items = [(i, prose(100 + i, rng.randint(1, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "..."), (93, "Short One"), (94, prose(100, 25)), (None, prose(777, 30))]
    docs = []
    for i in range(120):
        words = prose(i, rng.randint(0, 400)).split()
        item = items[rng.randrange(40)][1].split()
        kind = i % 5
        if kind == 1:
            words[10:10] = item
        elif kind == 2:
            words[5:5] = item[: max(1, int(len(item) * 0.85))]
        elif kind == 3:
            item[rng.randrange(len(item))] = "CHANGED"
            words += [w.upper() + "," for w in item]
        elif kind == 4:  # scattered over a long text
            words = (prose(i, 3000) + " " + " ".join(item[: len(item) // 2 + 2]) + " x " + prose(i + 1, 3000) + " " + " ".join(item[len(item) // 2 - 2 :])).split()
        docs.append(doc(i, " ".join(words)))
    docs += [doc(500, "a short one here"), doc(501, prose(777, 30))]
    found = D.contained_items(frame(spark, docs), spark.createDataFrame(items, ITEMS), block_bytes=block_bytes, pass_bytes=pass_bytes).collect()
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_common) for r in found} == brute([d[:2] for d in docs], items)
    clean = D.keep_clean(frame(spark, docs), spark.createDataFrame(items, ITEMS), block_bytes=block_bytes, pass_bytes=pass_bytes).collect()
    assert sorted(r.doc_id for r in clean) == sorted({d[0] for d in docs} - {r.doc_id for r in found})
    assert len(found) > 40 and len(found) == len({(r.doc_id, r.item_id) for r in found})


def test_awkward_rows(spark):
    items = [(1, prose(3, 80)), (2, None), (3, prose(2, 30))]
    found = D.contained_items(clashing(frame(spark)), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted([(8, 1), (8, 1), (7, 3)])
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_common) for r in found} == brute([d[:2] for d in awkward()], items)
    assert D.contained_items(frame(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0
    assert D.contained_items(frame(spark), spark.createDataFrame([], ITEMS)).count() == 0
    docs = clashing(frame(spark))
    clean = D.keep_clean(docs, spark.createDataFrame(items, ITEMS))
    assert clean.columns == docs.columns and clean.count() == 12 - 3
    assert D.keep_clean(docs, spark.createDataFrame([], ITEMS)).count() == 12 and D.keep_clean(frame(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0
