"""SimHash near-duplicates by the generalised pigeonhole principle.

Equal fingerprints are one node. The 64 bits are dealt into partitions, with
correlated bits together; a partition p gets a threshold t(p) >= -1 such that
the sum of (t(p) + 1) is limit + 1, so any two fingerprints within ``limit``
bits agree on some partition up to its threshold. Number, width and
thresholds are chosen by dynamic programming on the candidate counts that the
measured bits predict: from the 64 x 64 counts of bits set together follow the
exact mean and variance of the number of bits in which two nodes differ on a
partition, correlations included, and a beta-binomial with both gives the
share of pairs within each threshold. Fingerprints probe every value within
the threshold of each partition; those that meet are verified on all 64 bits.

Inside a bucket links are found by growing trees, so a bucket of n nodes
gives at most n - 1 links, not all pairs; connectivity is the same. A bucket
of more than ``BUCKET`` nodes is cut again: two fingerprints within ``limit``
bits agree wholly on one of limit + 1 parts of the other bits, so each of its
rows goes to one smaller bucket for each of those parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, LOWER_ASCII, join_unique, materialise, pick, table
from .components import connected_components

BITS = 64
SHINGLE = 4
LIMIT = 4
BUCKET = 20_000  # most nodes of a bucket that is searched as it is


def fingerprint(text: str | None) -> int:
    """The bit majorities of the XXH64 hashes of the text's word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[SHINGLE - 1 :] - 1 if len(words) >= SHINGLE else ends[-1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row."""
    frame = pick(docs, "doc_id", "text")
    schema = f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(text.as_py()) for text in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return frame.mapInArrow(run, schema)


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of nodes and the 64 x 64 counts of bits that are set together, summed over all nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
        if n:
            flat = np.concatenate((total.ravel(), [n]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "n"])

    rows = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for row in rows:
        flat[row.cell] = row.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(n: int, together: np.ndarray) -> np.ndarray:
    share = together.diagonal() / n
    cov = together / n - np.outer(share, share)
    scale = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return np.abs(cov / np.outer(scale, scale))


def grouped_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near equal width, each grown from the first free bit by the bit most correlated with it."""
    free = list(range(BITS))
    out = []
    for p in range(parts):
        width = BITS // parts + (p < BITS % parts)
        own = [free.pop(0)]
        while len(own) < width:
            best = max(free, key=lambda b: (corr[b, own].sum(), -b))
            free.remove(best)
            own.append(best)
        out.append(sorted(own))
    return out


def expected_pairs(n: int, together: np.ndarray, bits: list[int], most: int) -> list[float]:
    """For t = 0.. most: expected ordered pairs of nodes within t bits on ``bits``."""
    width = len(bits)
    both = together[np.ix_(bits, bits)] / n
    share = both.diagonal()
    one = share[:, None] - both  # the first bit set, the second not
    none = 1 - share[:, None] - share[None, :] + both
    differ = 2 * share * (1 - share)
    joint = 2 * (both * none + one * one.T)  # two nodes differ in both bits
    np.fill_diagonal(joint, differ)
    mean = float(differ.sum())
    variance = float(joint.sum() - mean * mean)
    m = min(max(mean / width, 1e-9), 1 - 1e-9)
    rho = min(max((variance / (width * m * (1 - m)) - 1) / max(width - 1, 1), 1e-6), 0.95)
    a, b = m * (1 - rho) / rho, (1 - m) * (1 - rho) / rho
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    chance = [math.comb(width, k) * math.exp(beta(k + a, width - k + b) - beta(a, b)) for k in range(min(most, width) + 1)]
    chance += [0.0] * (most + 1 - len(chance))
    return list(n * n * np.cumsum(chance))


def allocate(n: int, together: np.ndarray, partitions: list[list[int]], limit: int, probe_cost: float) -> tuple[float, list[int]]:
    """Least cost and the thresholds that reach it: sum of (t + 1) = limit + 1, t = -1 skips a partition."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in partitions:
        pairs = expected_pairs(n, together, bits, limit)
        costs = [0.0] + [pairs[t] + probe_cost * n * sum(math.comb(len(bits), d) for d in range(t + 1)) for t in range(min(limit, len(bits)) + 1)]
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for units, extra in enumerate(costs):
                if used + units <= limit + 1:
                    option = (cost + extra, [*chosen, units - 1])
                    if used + units not in after or option < after[used + units]:
                        after[used + units] = option
        best = after
    return best[limit + 1]


def plan(n: int, together: np.ndarray, limit: int = LIMIT, probe_cost: float = 30.0) -> list[tuple[list[int], int]]:
    """The partitions to probe with their thresholds, for the number of partitions that costs least."""
    corr = correlations(n, together)
    options = []
    for parts in range(1, limit + 2):
        partitions = grouped_bits(corr, parts)
        if parts == 1 and limit > 2:
            continue  # a ball of that radius on 64 bits is larger than any other choice
        options.append((*allocate(n, together, partitions, limit, probe_cost), partitions))
    _, thresholds, partitions = min(options, key=lambda o: o[0])
    return [(bits, t) for bits, t in zip(partitions, thresholds, strict=True) if t >= 0]


def probes(nodes: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (bucket, own, fp): each node in the bucket of its own value (own = 0) and of the values near it (own = 1)."""
    masks = []
    for p, (bits, t) in enumerate(chosen):
        base = sum(1 << b for b in bits)
        flips = [sum(1 << b for b in some) for d in range(t + 1) for some in combinations(bits, d)]
        masks.append((p, base, np.array(flips, np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for p, base, flips in masks:
                for part in np.array_split(fps, max(1, len(fps) * len(flips) // 500_000)):
                    values = (part & np.uint64(base))[:, None] ^ flips[None, :]
                    own = np.broadcast_to((np.arange(len(flips)) > 0).astype(np.int8), values.shape)
                    again = np.broadcast_to(part[:, None], values.shape)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(values.size, p, np.int8)), pa.array(values.ravel().view(np.int64)), pa.array(own.ravel()), pa.array(again.ravel().view(np.int64))], names=["p", "value", "probe", "fp"]
                    )

    return nodes.select("fp").mapInArrow(run, "p tinyint, value long, probe tinyint, fp long")


def links_in_bucket(own: np.ndarray, others: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Trees that join all fingerprints of a bucket that are within ``limit`` bits: own ones, and probes to own ones.

    A found probe is compared with the own rows that are left, since it may be
    all that joins them; probes aren't compared with each other.
    """
    if len(own) == 1:
        near = others[np.bitwise_count(others ^ own[0]) <= limit]
        if len(near):
            yield np.full(len(near), own[0], np.uint64), near
        return
    queue: list[np.uint64] = []
    probed: list[np.ndarray] = []  # probes found and not yet compared with the own rows that are left
    while len(own):
        if queue or not probed:
            if queue:
                seed = queue.pop()
            else:
                seed, own = own[0], own[1:]
            for mine in (True, False):
                rows = own if mine else others
                near = np.bitwise_count(rows ^ seed) <= limit
                if near.any():
                    found = rows[near]
                    yield np.full(len(found), seed, np.uint64), found
                    if mine:
                        queue += list(found)
                        own = own[~near]
                    else:
                        probed.append(found)
                        others = others[~near]
            continue
        # a probe joins own rows that are near it and not near each other
        seeds = probed.pop()
        width = max(1, 500_000 // len(own))
        if len(seeds) > width:
            probed.append(seeds[width:])
            seeds = seeds[:width]
        near = np.bitwise_count(own[:, None] ^ seeds[None, :]) <= limit
        some = near.any(axis=1)
        if some.any():
            yield seeds[near[some].argmax(axis=1)], own[some]
            queue += list(own[some])
            own = own[~some]
    # the own rows are all found: what is left of the queue can only reach probes
    for seed in queue:
        near = np.bitwise_count(others ^ seed) <= limit
        if near.any():
            yield np.full(int(near.sum()), seed, np.uint64), others[near]
            others = others[~near]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def cut_buckets(nodes: DataFrame, probed: DataFrame, chosen: list[tuple[list[int], int]], limit: int, most: int = BUCKET) -> DataFrame:
    """The probes with the rows of buckets that more than ``most`` nodes own dealt to smaller buckets by their other bits."""
    own = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(p).cast("tinyint").alias("p"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("value")) for p, (bits, _) in enumerate(chosen)))).alias("b"))
    large = materialise(own.groupBy("b.p", "b.value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("p", "value", F.lit(True).alias("large")), "simhash-large")
    if large.isEmpty():
        return probed
    marked = join_unique(materialise(probed, "simhash-probes"), large, ["p", "value"], "left")
    cases = F.lit(None).cast("array<struct<p:tinyint,value:bigint>>")
    for p, (bits, _) in enumerate(chosen):
        others = [b for b in range(BITS) if b not in bits]
        parts = [others[i :: limit + 1] for i in range(limit + 1)]
        finer = F.array(*(F.struct(F.lit(len(chosen) + p * (limit + 1) + i).cast("tinyint").alias("p"), F.col("value").bitwiseOR(F.col("fp").bitwiseAND(F.lit(_mask(part)))).alias("value")) for i, part in enumerate(parts)))
        cases = F.when(F.col("p") == p, finer).otherwise(cases)
    same = F.array(F.struct("p", "value"))
    dealt = marked.select("probe", "fp", F.explode(F.when(F.col("large"), cases).otherwise(same)).alias("b"))
    return dealt.select("b.p", "b.value", "probe", "fp")


def verified_links(probed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between fingerprints that meet in a bucket and differ in at most ``limit`` bits.

    Buckets arrive sorted, so a task holds one bucket of fingerprints, 9
    bytes each, at a time. Buckets of a single row are passed over at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None

        def solve(p: np.ndarray, value: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((value[1:] != value[:-1]) | (p[1:] != p[:-1])) + 1
            starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(value)]))
            n_own = np.add.reduceat((probe == 0).astype(np.int64), starts) if len(value) else np.zeros(0, np.int64)
            sizes = stops - starts
            a_out, b_out = [], []
            # buckets with one own row: every other row is compared with it, all buckets at once
            single = (n_own == 1) & (sizes > 1)
            if single.any():
                first = np.repeat(fp[starts[single]], sizes[single] - 1)
                lengths = sizes[single] - 1
                offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                second = fp[np.repeat(starts[single] + 1, lengths) + offset]
                near = np.bitwise_count(first ^ second) <= limit
                a_out.append(first[near])
                b_out.append(second[near])
            for i in np.flatnonzero(n_own > 1):
                a, b = starts[i], stops[i]
                for x, y in links_in_bucket(fp[a : a + n_own[i]], fp[a + n_own[i] : b], limit):
                    a_out.append(x)
                    b_out.append(y)
            if a_out:
                a_all, b_all = np.concatenate(a_out).astype(np.uint64), np.concatenate(b_out).astype(np.uint64)
                if len(a_all):
                    yield pa.RecordBatch.from_arrays([pa.array(a_all.view(np.int64)), pa.array(b_all.view(np.int64))], names=["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(4)]
            new[3] = new[3].view(np.uint64)
            if rest is not None:
                new = [np.concatenate((x, y)) for x, y in zip(rest, new, strict=True)]
            if not len(new[0]):
                continue
            last = np.flatnonzero((new[1][1:] != new[1][:-1]) | (new[0][1:] != new[0][:-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from solve(*(x[:cut] for x in new))
            rest = tuple(x[cut:] for x in new)
        if rest is not None and len(rest[0]):
            yield from solve(*rest)

    dealt = probed.repartition("p", "value").sortWithinPartitions("p", "value", "probe", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _components(nodes: DataFrame, limit: int, rows: int) -> DataFrame:
    """(node, component) of the fingerprints ``fp`` of ``nodes`` that have links."""
    n, together = bit_statistics(nodes)
    if not n:
        return nodes.select(F.col("fp").alias("node"), F.col("fp").alias("component"))
    chosen = plan(n, together, limit)
    links = materialise(verified_links(cut_buckets(nodes, probes(nodes, chosen), chosen, limit), limit), "simhash-links")
    return connected_components(links, rows)


def _named(nodes: DataFrame, limit: int, rows: int) -> DataFrame:
    """``nodes`` (fp, first, n) with ``best``, the smallest ``first`` of the node's component, and whether the node has links.

    Only nodes with links are joined by component.
    """
    parts = _components(nodes, limit, rows)
    linked = materialise(join_unique(nodes, materialise(parts.select(F.col("node").alias("fp"), "component"), "simhash-parts"), ["fp"], "inner", rows), "simhash-linked")
    best = materialise(linked.groupBy("component").agg(F.min("first").alias("best")), "simhash-best")
    named = materialise(join_unique(linked, best, ["component"], "inner", rows).select("fp", "best"), "simhash-named")
    return join_unique(nodes, named, ["fp"], "left", rows).select("fp", "first", "n", F.coalesce("best", "first").alias("best"), F.col("best").isNotNull().alias("linked"))


def near_duplicates(docs: DataFrame, limit: int = LIMIT, rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits) and component_id of every row.

    A component holds all rows linked by chains of fingerprints at most
    ``limit`` bits apart; its id is its smallest doc_id (null where it has
    none). Null and empty texts have fingerprint zero and link like others;
    equal texts, ties and repeated rows share a node; a text of any length is
    hashed whole; columns besides doc_id and text are not looked at whatever
    their names; an empty table gives no rows. Joins broadcast up to ``rows``
    rows, beyond it only hot keys.
    """
    marked = materialise(fingerprints(docs), "simhash-fps")
    nodes = materialise(marked.groupBy("fp").agg(F.struct(F.min("doc_id").alias("id")).alias("first"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    # a null id is no id: it sorts last
    ordered = nodes.select("fp", "n", F.struct(F.col("first.id").isNull().alias("none"), F.col("first.id").alias("id")).alias("first"))
    ids = materialise(_named(ordered, limit, rows).select("fp", F.col("best.id").alias("component_id")), "simhash-ids")
    return join_unique(marked, ids, ["fp"], "inner", rows).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, limit: int = LIMIT, rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that with the smallest doc_id.

    Rows without an id come after all others, and rows of equal id by their
    place, so repeated rows and near copies without an id go like others.
    Which rows go is decided by a row number that is written with them, never
    by an id. Null and empty texts are near copies of one another. Other cases
    are as in ``near_duplicates``.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(columns))])
    text_at = columns.index("text")
    schema = T.StructType([*plain.schema.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(text.as_py()) for text in batch.column(text_at)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=schema.names)

    marked = materialise(plain.mapInArrow(run, schema).withColumn("r", F.monotonically_increasing_id()), "simhash-rows")
    doc_id = F.col(f"_c{columns.index('doc_id')}")
    first = F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.col("r"))).alias("first")
    nodes = materialise(marked.groupBy("fp").agg(first, F.count(F.lit(1)).alias("n")), "simhash-nodes")
    several = materialise(_named(nodes, limit, rows).filter("linked or n > 1").select("fp", F.col("best.r").alias("kept")), "simhash-several")
    gone = materialise(join_unique(marked.select("fp", "r"), several, ["fp"], "inner", rows).filter("r <> kept").select("r"), "simhash-gone")
    few = gone.limit(rows + 1).count() <= rows
    return marked.join(F.broadcast(gone) if few else gone, "r", "left_anti").select(*plain.columns).toDF(*columns)


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
