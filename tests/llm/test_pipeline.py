import os
import random
import re
import subprocess
import sys
import tracemalloc

import pyarrow as pa

import corpus_pipeline
from folioframe.llm import decontaminate as D
from folioframe.llm import quality as Q
from folioframe.llm import secrets as X
from folioframe.llm.pieces import Pieces, sample_chunk

from .helpers import DOCS, awkward, doc, prose
from .test_quality import brute_statistics
from .test_simhash import brute_fingerprint, brute_labels

ITEM = prose(4321, 25)


def documents():
    rows = awkward() + [doc(20 + i, prose(20 + i, 60 + i)) for i in range(30)]
    rows += [doc(60, prose(70, 50) + " " + ITEM.upper() + " " + prose(71, 50)), doc(61, prose(72, 50) + ' token = "0123456789abcdef01234567" ' + prose(73, 20)), doc(62, "spam " * 100)]
    return rows + [doc(63, prose(20, 60) + " coda"), doc(64, prose(25, 65))]


def one_of_each(rows):
    """Of each component the row with the smallest id, none last, then the first."""
    best = {}
    for place, (r, label) in enumerate(zip(rows, brute_labels([brute_fingerprint(r[1]) for r in rows]))):
        best[label] = min(best.get(label, (True, 0, len(rows))), (r[0] is None, r[0] or 0, place))
    return [rows[place] for place in sorted(place for _, _, place in best.values())]


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(documents(), DOCS).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    found = corpus_pipeline.run(spark, folder).collect()

    rows = []
    for r in documents():  # none of these lies far from the others, so the base rules alone decide
        s = brute_statistics(r[1])
        if s[0] >= 10 and 100 * s[4] <= 20 * s[0]:
            rows.append(r[:2])
    rows = one_of_each(rows)
    item = D.words_of(ITEM)
    shingles = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
    rows = [r for r in rows if 100 * len(shingles & {tuple(D.words_of(r[1])[i : i + 5]) for i in range(len(D.words_of(r[1])))}) < 80 * len(shingles)]
    rows = [(i, X.redacted(t)) for i, t in rows]
    pieces = Pieces()
    expected = {}
    for i, t in rows:
        for _, rank, ids, log_prob, value, inclusion, ok in sample_chunk(pieces, [i], [t], 2, 0):
            expected[i, rank] = (ids.tolist(), log_prob, value, inclusion, ok)
    assert {(r.doc_id, r.sample): (r.ids, r.log_prob, r.perturbed, r.log_inclusion, r.round_trip) for r in found} == expected
    assert {pieces.decode(r.ids) for r in found} == {t for _, t in rows}
    kept = {i for i, _ in expected}
    assert {60, 62, 64, 2, 4, 5, 10}.isdisjoint(kept) and {1, 7, 8, 9, 61, None} <= kept


def test_stages_keep_columns_and_take_empty_input(spark, tmp_path):
    folder = str(tmp_path)
    empty = spark.createDataFrame([], DOCS)
    empty.write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(documents(), DOCS), folder)
        assert out.columns == empty.columns and out.count() > 0
        assert stage(spark, empty, folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_rows_that_share_an_id_or_have_none_do_not_share_a_verdict(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    good = [doc(i, prose(200 + place, 70)) for place, i in enumerate((None, None, 5, 6, 6))]
    short = [doc(None, "too short"), doc(5, None), doc(6, "")]
    leaks = [doc(None, prose(300, 40) + " " + ITEM), doc(5, ITEM), doc(6, prose(301, 30) + " " + ITEM)]
    left = lambda rows: sorted(((r[0] is None, r[0] or 0, r[1]) for r in rows))
    out = corpus_pipeline.quality_rules(spark, spark.createDataFrame(good + short, DOCS), folder).collect()
    assert left(out) == left(good)
    out = corpus_pipeline.decontaminate(spark, spark.createDataFrame(good + leaks, DOCS), folder).collect()
    assert left(out) == left(good)
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(good + good + [doc(9, good[0][1])], DOCS), folder).collect()
    assert left(out) == left([doc(9, good[0][1])] + good[1:])


def encoder(spark, monkeypatch):
    """What the workers run in the last stage."""
    found, docs = [], spark.createDataFrame([], DOCS)
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, run, schema: found.append(run) or spark.createDataFrame([], schema))
        corpus_pipeline.encode(spark, docs, "")
    return found[0]


def test_encoding_takes_little_memory(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(2000)) for _ in range(120)]
    assert 1_200_000 < sum(map(len, texts)) < 2_000_000
    run = encoder(spark, monkeypatch)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    list(run(iter([batch.slice(0, 1)])))  # the vocabulary stays
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 2 * len(texts) and most < 100e6


def test_chunks_of_any_size_give_the_same_rows():
    from folioframe.llm.pieces import _chunk_rows

    rows = documents()
    pieces, ids, texts = Pieces(), pa.array([r[0] for r in rows], pa.int64()), [r[1] or "" for r in rows]
    whole = _chunk_rows(pieces, ids, texts, 2, 0).to_pylist()
    assert [x for i in range(len(rows)) for x in _chunk_rows(pieces, ids.slice(i, 1), texts[i : i + 1], 2, 0).to_pylist()] == whole


GIVEN_BACK = """
import re
from pathlib import Path
import numpy as np
from folioframe.llm.common import give_back
size = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
before, rows = size(), []
for i in range(2000):
    rows += [np.ones(12_000), np.ones(20)]  # 96 kB each, with something small after it that stays
kept = rows[1::2]
del rows
held = size() - before
give_back()
print(held, size() - before)
"""


def test_freed_memory_goes_back_to_the_system():
    out = subprocess.run([sys.executable, "-c", GIVEN_BACK], capture_output=True, text=True, check=True, cwd=os.path.dirname(corpus_pipeline.__file__)).stdout
    held, left = map(float, re.findall(r"[\d.]+", out))
    assert held > 100 and left < 30


def test_catalogue_names():
    from folioframe.llm import oracle_sql, queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
    assert Q.P == len(Q.FLOORS)
