"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document may be long, so the resemblance of the
two sets of word shingles is tiny; what counts is containment, the share of
the item's shingles that the document has. Each item gets a bottom-k MinHash
sketch of its shingles, with k set by the item's size class: an item of n
shingles that is contained to ``threshold`` misses at most
``n - ceil(threshold * n)`` of them, so of k = misses + hits sketched shingles
at least ``hits`` must occur in the document. The search therefore loses
nothing, whatever the lengths. Sketches are filed by size class, and a
document looks only into the classes that could fit into it. Candidates are
verified by the exact number of common shingles.

The items are handed to the workers in blocks of some ``block_bytes`` of text.
A worker builds the index of a block once and keeps it for all its tasks; one
pass over the documents searches as many blocks as hold ``pass_bytes``, so a
benchmark of usual size takes a single pass.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pick, table

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORD.findall(text.lower()) if text else []


def _mixed(values: np.ndarray) -> np.ndarray:
    x = values + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` word numbers."""
    n = len(ids) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(width):
        out = _mixed(out ^ ids[i : i + n].astype(np.uint64))
    return out


def size_class(n: int) -> int:
    return n.bit_length() - 1


class Index:
    """The sketches of a block of items, filed by shingle width and size class."""

    def __init__(self, items: list[tuple[object, str | None]], percent: int, shingle: int) -> None:
        split = [(item_id, words_of(text)) for item_id, text in items]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in split for w in words}))}
        # item_id, number of shingles, their sorted hashes and word numbers, least common ones, least sketch hits
        self.items: list[tuple[object, int, np.ndarray, np.ndarray, int, int]] = []
        filed: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item_id, words in split:
            if not words:
                continue
            width = min(shingle, len(words))
            ids = np.array([self.vocabulary[w] for w in words], np.int64)
            own = window_hashes(ids, width)
            hashes, first = np.unique(own, return_index=True)
            n = len(hashes)
            need = -(-percent * n // 100)
            hits = min(need, max(1, (1 << size_class(n)) // 8))
            sketch = hashes[: n - need + hits]
            number = len(self.items)
            self.items.append((item_id, n, hashes, ids[first[:, None] + np.arange(width)].astype(np.int32), need, hits))
            filed.setdefault((width, size_class(need)), []).extend((int(h), number) for h in sketch)
        self.classes = []
        for (width, cls), postings in sorted(filed.items()):
            postings.sort()
            self.classes.append((width, 1 << cls, np.array([h for h, _ in postings], np.uint64), np.array([i for _, i in postings], np.int64)))
        self.widths = sorted({width for width, *_ in self.classes})

    def search(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item_id, its shingles, how many of them the text has) for each item contained to the threshold."""
        words = words_of(text)
        if not words or not self.classes:
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        found = []
        for width in self.widths:
            if len(ids) < width:
                continue
            known = np.cumsum(np.concatenate(([0], ids >= 0)))
            at = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(at):
                continue
            runs = ids[at[:, None] + np.arange(width)]
            hashes = np.zeros(len(at), np.uint64)
            for i in range(width):
                hashes = _mixed(hashes ^ runs[:, i].astype(np.uint64))
            hashes, first = np.unique(hashes, return_index=True)
            hits: dict[int, int] = {}
            for w, least, sketched, owners in self.classes:
                if w != width or len(hashes) < least:
                    continue
                low, high = np.searchsorted(sketched, hashes, "left"), np.searchsorted(sketched, hashes, "right")
                for i in np.flatnonzero(high > low):
                    for number in owners[low[i] : high[i]].tolist():
                        hits[number] = hits.get(number, 0) + 1
            candidates = [number for number, n in hits.items() if n >= self.items[number][5]]
            if candidates:
                shingles = runs[first]
                for number in sorted(candidates):
                    item_id, n, own, words_of_own, need, _ = self.items[number]
                    at = np.searchsorted(hashes, own)
                    at[at == len(hashes)] = 0
                    same = hashes[at] == own
                    common = int((shingles[at[same]] == words_of_own[same]).all(axis=1).sum())
                    if common >= need:
                        found.append((item_id, n, common))
        return found


#: Indexes of this worker, by the name of their pass and their number in it.
_INDEXES: dict[tuple[str, int], Index] = {}

Block = list[tuple[object, str | None]]


def _passes(benchmark: DataFrame, block_bytes: int, pass_bytes: int) -> Iterator[list[Block]]:
    """The items in blocks, as many together as hold ``pass_bytes`` of text; the driver holds one pass at a time."""
    blocks: list[Block] = []
    block: Block = []
    size = total = 0
    for row in pick(benchmark, "item_id", "text").toLocalIterator():
        if not words_of(row.text):
            continue
        block.append((row.item_id, row.text))
        size += len(row.text.encode("utf-8", "replace"))
        if size >= block_bytes:
            blocks.append(block)
            total += size
            block, size = [], 0
            if total >= pass_bytes:
                yield blocks
                blocks, total = [], 0
    if block:
        blocks.append(block)
    if blocks:
        yield blocks


def _indexes(name: str, blocks: list[Block], percent: int, shingle: int) -> list[Index]:
    """The indexes of a pass, built once in a worker; those of other passes are dropped."""
    for key in [key for key in _INDEXES if key[0] != name]:
        del _INDEXES[key]
    for i, block in enumerate(blocks):
        if (name, i) not in _INDEXES:
            _INDEXES[name, i] = Index(block, percent, shingle)
    return [_INDEXES[name, i] for i in range(len(blocks))]


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = 80, shingle: int = SHINGLE, block_bytes: int = 8 << 20, pass_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, item_id, n_shingles, n_common and containment of every contained item of every row.

    Shingles are ``shingle`` words, in lower case and without punctuation;
    an item of fewer words is one shingle of all its words, looked for as
    such. Null and empty texts and items have no shingles and never match;
    repeated rows match each; of items with equal text each is reported; a
    text of any length is searched whole; columns besides doc_id, item_id and
    text are not looked at whatever their names; empty tables give no rows.
    """
    spark = docs.sparkSession
    frame = pick(docs, "doc_id", "text")
    item_type = pick(benchmark, "item_id").schema["item_id"].dataType
    schema = f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, n_shingles long, n_common long"

    def searched(blocks: list[Block]) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(blocks), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = _indexes(name, shared.value, percent, shingle)
            for batch in batches:
                rows = [(doc_id, *hit) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for index in indexes for hit in index.search(text.as_py())]
                if rows:
                    a, b, c, d = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(0).type), pa.array(b), pa.array(c, pa.int64()), pa.array(d, pa.int64())], names=["doc_id", "item_id", "n_shingles", "n_common"])

        return frame.mapInArrow(run, schema)

    results: list[DataFrame] = []
    passes = _passes(benchmark, block_bytes, pass_bytes)
    waiting = next(passes, [])
    while waiting:
        after = next(passes, [])
        out = searched(waiting)
        results.append(materialise(out, "contained") if after or results else out)
        waiting = after
    if not results:
        return spark.createDataFrame([], schema + ", containment double")
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    return every.withColumn("containment", F.col("n_common") / F.col("n_shingles"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80, shingle: int = SHINGLE, block_bytes: int = 8 << 20, pass_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that contain no item of the benchmark, with their columns.

    Each row is searched and kept or dropped for itself, whatever its id, in
    the pass that reads it. Other cases are as in ``contained_items``.
    """
    spark = docs.sparkSession
    columns, text_at = docs.columns, docs.columns.index("text")
    left = docs.toDF(*[f"_c{i}" for i in range(len(columns))])

    def cleaned(frame: DataFrame, blocks: list[Block]) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(blocks), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = _indexes(name, shared.value, percent, shingle)
            for batch in batches:
                clean = []
                for text in batch.column(text_at):
                    body = text.as_py()
                    clean.append(not any(index.search(body) for index in indexes))
                yield batch.filter(pa.array(clean, pa.bool_()))

        return frame.mapInArrow(run, frame.schema)

    passes = _passes(benchmark, block_bytes, pass_bytes)
    waiting = next(passes, [])
    while waiting:
        after = next(passes, [])
        left = cleaned(left, waiting)
        if after:
            left = materialise(left, "clean")
        waiting = after
    return left.toDF(*columns)


def op4_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), doc_words AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), item_shingles AS (
    SELECT DISTINCT item_id, least(5, len(w)) AS width,
           unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s
    FROM item_words WHERE len(w) > 0
), widths AS (
    SELECT DISTINCT width FROM item_shingles
), doc_shingles AS (
    SELECT DISTINCT doc_id, width,
           unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS s
    FROM doc_words, widths WHERE len(w) >= width
), sizes AS (
    SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id
), common AS (
    SELECT doc_id, item_id, count(*) AS n_common FROM doc_shingles JOIN item_shingles USING (width, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shingles, n_common, n_common / n_shingles::DOUBLE AS containment
FROM common JOIN sizes USING (item_id)
WHERE 100 * n_common >= 80 * n_shingles
"""
