"""Sharding by histogram sort (law ``bytes``), in DataFrame operations only.

Rows are ordered by the key (xxhash64 of the text, doc_id, hash of a row
number). Candidate boundaries are prefixes of that 192-bit key. Each round
sums, in one aggregation over the keys, the exact bytes and rows under every
child of the prefixes that still hold an unmet target, and picks the child
that holds it. A target is met when a boundary lies within ``tolerance`` of a
shard's size. All rows are counted in every sum; only the sums reach the
driver, at most ``probes`` a round or four for each range. Then the rows are
exchanged once.

Equal texts have equal hashes, so a group of copies stays together unless it
is itself larger than the tolerance; then it is cut by doc_id, and rows of
equal text and id by their row number. That number is written with the keys
once, so every later read sees the same.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, pick, table

BIAS = -(1 << 63)
FULL = 1 << 64
WORDS = ("k1", "k2", "k3")
DEPTH = 64 * len(WORDS)
LAW = "bytes"


def _unsigned(value: int) -> int:
    return value & (FULL - 1)


def _signed(value: int) -> int:
    return value - FULL if value >= FULL >> 1 else value


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, size, text_crc32, text and the columns named in ``more`` (as _k0..) of every row.

    A null text counts as no bytes and has the checksum of an empty text.
    """
    frame = pick(docs, *dict.fromkeys(("doc_id", "text", *more)))
    body = F.coalesce(F.col("text"), F.lit(""))
    return frame.select(
        "doc_id",
        "text",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
        *(F.col(name).alias(f"_k{i}") for i, name in enumerate(more)),
    )


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``sizes`` without the text, with the three 64-bit words of the key, which order as unsigned numbers.

    A null doc_id sorts first. To be written before it is used: the row number
    is that of this run.
    """
    return sizes(docs, *more).select(
        "doc_id",
        "size",
        "text_crc32",
        F.xxhash64("text").alias("k1"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(BIAS)).bitwiseXOR(F.lit(BIAS)).alias("k2"),
        F.xxhash64(F.monotonically_increasing_id()).alias("k3"),
        *(f"_k{i}" for i in range(len(more))),
    )


@dataclass(frozen=True)
class Splitters:
    """Ascending key boundaries; range i holds the keys from bounds[i-1] (included) to bounds[i]."""

    bounds: list[tuple[int, int, int]]  # unsigned words
    rows_below: list[int]
    per_shard: int
    rounds: int


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the key: whole words, then a word shifted down, then zeros."""
    parts = []
    for i, word in enumerate(WORDS):
        bits = min(64, max(0, depth - 64 * i))
        parts.append((F.shiftrightunsigned(word, 64 - bits) if bits else F.lit(0).cast("long")).alias(f"w{i}"))
    return F.struct(*parts)


def _words_of(value: int, depth: int) -> list[int]:
    """A prefix of ``depth`` bits as the words that ``_prefix`` gives."""
    out = []
    for i in range(len(WORDS)):
        bits = min(64, max(0, depth - 64 * i))
        below = max(0, depth - 64 * (i + 1))
        out.append(_signed((value >> below) & ((1 << bits) - 1)) if bits else 0)
    return out


def _value_of(prefix, depth: int) -> int:
    value = 0
    for i in range(len(WORDS)):
        bits = min(64, max(0, depth - 64 * i))
        value = (value << bits) | _unsigned(prefix[f"w{i}"])
    return value


def find_splitters(keys: DataFrame, shards: int, tolerance: float, range_bytes: int, probes: int) -> Splitters:
    spark = keys.sparkSession
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (shards * range_bytes)))
    parts = shards * per_shard
    slack = tolerance * total / parts
    unmet = {i: total * i / parts for i in range(1, parts)} if total else {}
    met: dict[int, tuple[int, int, int]] = {}
    # open prefixes: value -> bytes and rows before it
    opened: dict[int, tuple[int, int]] = {0: (0, 0)}
    holds = {0: list(unmet)}
    depth = rounds = 0
    within = None  # rows under the open prefixes
    while unmet and depth < DEPTH:
        bits = max(2, min(12, (max(4, probes // len(opened))).bit_length() - 1))
        # few rows have few children, however deep: go on to the end of the word
        deeper = 64 * (depth // 64 + 1) if within is not None and within <= probes else min(64 * (depth // 64 + 1), depth + bits)
        step = deeper - depth
        rounds += 1
        rows = keys
        if depth:
            known = [tuple(_words_of(v, depth)) for v in opened]
            wanted = spark.range(len(known)).select(F.struct(*(F.get(_numbers([k[i] for k in known]), F.col("id").cast("int")).alias(f"w{i}") for i in range(len(WORDS)))).alias("p"))
            rows = rows.join(F.broadcast(wanted), _prefix(depth) == F.col("p"), "left_semi")
        counted = rows.groupBy(_prefix(deeper).alias("p")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        children: dict[int, list[tuple[int, int, int]]] = {}
        for row in counted:
            value = _value_of(row.p, deeper)
            children.setdefault(value >> step, []).append((value, row["size"], row.n))
        next_opened: dict[int, tuple[int, int]] = {}
        next_holds: dict[int, list[int]] = {}
        below: dict[int, int] = {}
        for parent, targets in holds.items():
            size, n = opened[parent]
            ordered = iter(sorted(children.get(parent, [])))
            child = next(ordered)
            for i in sorted(targets):
                aim = unmet[i]
                while size + child[1] <= aim:
                    size, n = size + child[1], n + child[2]
                    child = next(ordered)
                low, high = aim - size, size + child[1] - aim
                if min(low, high) <= slack or deeper == DEPTH:
                    above = high < low
                    edge = (child[0] + above) << (DEPTH - deeper)
                    met[i] = (edge, 0, n + child[2] * above)
                    del unmet[i]
                else:
                    next_opened[child[0]] = (size, n)
                    below[child[0]] = child[2]
                    next_holds.setdefault(child[0], []).append(i)
        opened, holds, depth, within = next_opened, next_holds, deeper, sum(below.values())
    edges = [met.get(i, (0, 0, 0)) for i in range(1, parts)]
    bounds = [tuple((e >> 64 * i) & (FULL - 1) if i < len(WORDS) - 1 else e >> 64 * i for i in reversed(range(len(WORDS)))) for e, _, _ in edges]
    return Splitters(bounds, [n for _, _, n in edges], per_shard, rounds)


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(splitters: Splitters) -> Column:
    """How many boundaries lie at or below the row's key.

    The first bits, as many as tell the boundaries apart on average, say which few are to be compared.
    """
    bounds = splitters.bounds
    if not bounds:
        return F.lit(0)
    top = min(18, max(10, len(bounds).bit_length()))
    zeros = (0,) * (len(WORDS) - 1)
    below = [bisect.bisect_right(bounds, (slot << (64 - top), *zeros)) for slot in range(1 << top)]
    within = [*below[1:], len(bounds)]
    # a boundary past the last key is above all rows
    words = [_numbers([_signed(b[i]) ^ BIAS if b[0] < FULL else (1 << 63) - 1 for b in bounds]) for i in range(len(WORDS))]
    slot = F.shiftrightunsigned("k1", 64 - top).cast("int")
    low, high = F.get(_numbers(below), slot).cast("int"), F.get(_numbers(within), slot).cast("int")
    own = [F.col(w).bitwiseXOR(F.lit(BIAS)) for w in WORDS]

    def reached(i: Column) -> Column:
        at_least = own[-1] >= F.get(words[-1], i)
        for word, edges in list(zip(own, words, strict=True))[-2::-1]:
            at_least = (word > F.get(edges, i)) | ((word == F.get(edges, i)) & at_least)
        return at_least

    passed = F.aggregate(F.sequence(low, high - 1), F.lit(0), lambda n, i: n + F.when(reached(i), 1).otherwise(0))
    return low + F.when(high > low, passed).otherwise(0)


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.005, range_bytes: int = 1 << 30, probes: int = 61440, keep: tuple[str, ...] = ()) -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes.

    Returns doc_id, the columns named in ``keep`` (such as text), size,
    text_crc32, shard and slot (gapless from 0 in each shard, in key order).
    Null ids sort first, null and empty texts count one byte; copies share a
    shard where their group is within the tolerance, larger groups are cut,
    also rows of equal text and id; a text larger than a shard is still one
    row; an empty table gives no rows; other columns are not looked at
    whatever their names. ``range_bytes`` bounds the text behind the rows that
    one task sorts, but for a single longer text: a shard is cut into as many
    ranges as that needs, whose first slots are known from the counts.
    """
    rows = materialise(keyed(docs, *keep), "shard-keys")
    found = find_splitters(rows, shards, tolerance, range_bytes, probes)
    starts = [0, *found.rows_below]
    offset = [starts[i] - starts[i - i % found.per_shard] for i in range(len(starts))]
    piece = Window.partitionBy("piece").orderBy(*(F.col(w).bitwiseXOR(F.lit(BIAS)) for w in WORDS))
    return rows.withColumn("piece", _range_of(found).cast("int")).select(
        "doc_id",
        *(F.col(f"_k{i}").alias(name) for i, name in enumerate(keep)),
        "size",
        "text_crc32",
        F.floor(F.col("piece") / found.per_shard).cast("int").alias("shard"),
        (F.get(_numbers(offset), F.col("piece")) + F.row_number().over(piece) - 1).cast("long").alias("slot"),
    )


def op5_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
