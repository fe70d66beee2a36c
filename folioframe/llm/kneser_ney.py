"""Interpolated modified Kneser-Ney model of bigrams or trigrams, counted in Spark and scored from memory-mapped arrays.

Each pass is bounded by a chunk of tokens in memory:

1. Words: chunk counts of 64-bit word hashes are summed; the sorted hash
   arrays with their counts are written in parts by the hash's top bits. A
   word's number is its place in that order, so a bigram is one exact integer
   (context number * numbers + word number) and a trigram that of its first
   two words beside its last.
2. Trigrams, if ``order`` is 3, else bigrams: each chunk's distinct ones are
   cut at bigram boundaries that split the token mass evenly (also inside one
   very common context) and sent as compressed sorted runs, one exchange for
   all. Each range merges its runs and writes its sorted contexts, their
   totals, keys and counts.
3. Trigrams send on in how many contexts each bigram occurs; these runs are
   merged like those of counted bigrams. Bigrams that begin a text have no
   word before them and keep their counts.
4. Bigrams send on the number of contexts of each word; these continuation
   counts are summed by ranges of words.

The files lie in the shared folder; workers map them and look up sorted
needles, so a lookup reads forward. Discounts are the usual closed form of
the counts of counts of each order. Start of text is a context, end of text is
a token. Words are told apart by 64-bit hashes: of n words some n * n / 2**65
pairs are expected to be taken for one. Bigram numbers need 63 bits, so more
than ``MOST_WORDS`` words are refused, never wrapped round.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_ASCII, materialise, pick, run_dir, table

CHUNK = 3_000_000  # tokens counted together
SCORED = 1_000_000  # tokens scored together
RANGE = 3_000_000  # tokens behind one range of bigrams
PART = 1_000_000  # words in one part
MOST_RANGES = 16_384  # so that ranges, files and what the driver knows of them stay bounded; beyond it ranges hold more tokens
MOST_WORDS = 3_037_000_498  # the square of one more is below 2**63


def training(folds: int, fold: int) -> Column:
    """Whether a row is learned from: crc32 of the id as text, null as empty, leaves another remainder."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % folds != fold


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, an end (the empty word) after each text, and the number of tokens of each text."""
    words: list[bytes] = []
    lengths = []
    for text in texts:
        own = text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split() if text else []
        words += own
        words.append(b"")
        lengths.append(len(own) + 1)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.array(lengths, np.int64)


def _texts(batch: pa.RecordBatch, column: int, chars: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """The texts of a batch in runs of about ``chars`` characters."""
    start, size, run = 0, 0, []
    for i, text in enumerate(batch.column(column)):
        run.append(text.as_py())
        size += len(run[-1] or "") + 1
        if size >= chars:
            yield start, i + 1, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, batch.num_rows, run


class Store:
    """Arrays as raw little-endian files in the shared folder; mapped where it is mounted, else copied once a worker machine."""

    def __init__(self, uri: str) -> None:
        self.uri = uri

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, values: np.ndarray) -> None:
        """Written aside and moved, so that a repeated task leaves one whole file."""
        files, folder = self._fs()
        files.create_dir(folder, recursive=True)
        aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as out:
            out.write(np.ascontiguousarray(values).tobytes())
        files.move(aside, f"{folder}/{name}")

    def read(self, name: str, dtype: str) -> np.ndarray:
        from pyarrow import fs

        files, folder = self._fs()
        path = f"{folder}/{name}"
        if not isinstance(files, fs.LocalFileSystem):
            local = f"{tempfile.gettempdir()}/{folder.replace('/', '_')}_{name}"
            if not os.path.exists(local):
                atexit.register(lambda: os.path.exists(local) and os.remove(local))
                with files.open_input_stream(path) as source, open(f"{local}.{os.getpid()}", "wb") as out:
                    while block := source.read(1 << 22):
                        out.write(block)
                os.replace(f"{local}.{os.getpid()}", local)
            path = local
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


def packed(values: np.ndarray) -> bytes:
    """Sorted or small integers, compressed: differences, byte plane by byte plane."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def packed_values(values: np.ndarray) -> bytes:
    """Integers in any order, compressed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked_values(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel().astype(np.int64)


def distinct_pairs(context: np.ndarray, word: np.ndarray, times: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (context, word) in order, with their times (one each where none are given)."""
    if len(context) and (int(context.max()) + 1) * width < 1 << 63:  # both fit one integer
        key = context * width + word
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort((word, context))
    context, word = context[order], word[order]
    starts = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])))) if len(context) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((starts, [len(context)]))) if times is None else np.add.reduceat(times[order], starts) if len(starts) else np.zeros(0, np.int64)
    return context[starts], word[starts], counts


@dataclass
class Words:
    """Sorted word hashes in parts by their top bits."""

    uri: str
    top: int
    offsets: list[int]  # first number of each part
    maps: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"maps": {}}

    def _map(self, name: str, dtype: str) -> np.ndarray:
        if name not in self.maps:
            self.maps[name] = Store(self.uri).read(name, dtype)
        return self.maps[name]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of ascending distinct hashes."""
        numbers, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(hashes >> np.uint64(64 - self.top) if self.top else np.zeros(len(hashes), np.uint64), np.arange((1 << self.top) + 1, dtype=np.uint64))
        for part in range(1 << self.top):
            a, b = cuts[part], cuts[part + 1]
            if a == b or self.offsets[part] == self.offsets[part + 1]:
                continue
            known = self._map(f"words-{part}", "<u8")
            at = np.searchsorted(known, hashes[a:b])
            at[at == len(known)] = 0
            hit = known[at] == hashes[a:b]
            numbers[a:b] = np.where(hit, at + self.offsets[part], -1)
            counts[a:b] = np.where(hit, self._map(f"counts-{part}", "<i8")[at], 0)
        return numbers, counts


@dataclass
class Model:
    """What a worker needs to score, but for the files: sizes, boundaries, discounts."""

    words: Words
    tokens: int  # N
    vocabulary: int  # V
    bounds: np.ndarray  # first key of each range of bigrams but the first
    filled: frozenset[int]  # the ranges that hold bigrams
    heavy: dict[int, np.ndarray]  # totals of the contexts that were cut
    word_bounds: np.ndarray
    discounts: np.ndarray  # of bigrams, for counts 0, 1, 2, 3 and more
    lower: np.ndarray  # of continuation counts
    lower_total: int
    lower_rest: float  # mass that the continuation counts leave to the uniform distribution
    order: int = 2
    upper: np.ndarray | None = None  # discounts of trigrams
    filled3: frozenset[int] = frozenset()  # the ranges that hold trigrams

    def __post_init__(self) -> None:
        self.maps: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"maps": {}}

    def _map(self, name: str, dtype: str) -> np.ndarray:
        if name not in self.maps:
            self.maps[name] = Store(self.words.uri).read(name, dtype)
        return self.maps[name]

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ascending distinct keys."""
        out = np.zeros(len(keys), np.int64)
        cuts = [0, *np.searchsorted(keys, self.bounds).tolist(), len(keys)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b and p in self.filled:
                known = self._map(f"keys-{p}", "<i8")
                at = np.searchsorted(known, keys[a:b])
                at[at == len(known)] = 0
                out[a:b] = np.where(known[at] == keys[a:b], self._map(f"times-{p}", "<i8" if self.tokens >> 32 else "<u4")[at], 0)
        return out

    def contexts(self, numbers: np.ndarray) -> np.ndarray:
        """Total count and the numbers of words seen once, twice and more often, of ascending distinct contexts."""
        out = np.zeros((len(numbers), 4), np.int64)
        ranges = np.searchsorted(self.bounds, numbers * (self.vocabulary + 1), "right")
        cuts = np.searchsorted(ranges, np.arange(len(self.bounds) + 2))
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b and p in self.filled:
                known = self._map(f"contexts-{p}", "<i8")
                at = np.searchsorted(known, numbers[a:b])
                at[at == len(known)] = 0
                totals = self._map(f"totals-{p}", "<i8").reshape(-1, 4)
                out[a:b] = np.where((known[at] == numbers[a:b])[:, None], totals[at], 0)
        if self.heavy:
            for i in np.flatnonzero(np.isin(numbers, np.fromiter(self.heavy, np.int64))):
                out[i] = self.heavy[int(numbers[i])]
        return out

    def trigrams(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals of the contexts as ``contexts`` gives them, and counts, of (bigram number, word number) in any order."""
        totals, times = np.zeros((len(contexts), 4), np.int64), np.zeros(len(contexts), np.int64)
        of, where = np.unique(contexts, return_inverse=True)
        ranges = np.searchsorted(self.bounds, of, "right")
        place = np.full(len(of), -1, np.int64)
        known_totals = np.zeros((len(of), 4), np.int64)
        cuts = np.searchsorted(ranges, np.arange(len(self.bounds) + 2))
        by_range = np.argsort(ranges[where], kind="stable")
        token_cuts = np.searchsorted(ranges[where][by_range], np.arange(len(self.bounds) + 2))
        kind = "<i8" if self.tokens >> 32 else "<u4"
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a == b or p not in self.filled3:
                continue
            known = self._map(f"contexts3-{p}", "<i8")
            at = np.searchsorted(known, of[a:b])
            at[at == len(known)] = 0
            hit = known[at] == of[a:b]
            place[a:b] = np.where(hit, at, -1)
            known_totals[a:b] = np.where(hit[:, None], self._map(f"totals3-{p}", kind).reshape(-1, 4)[at], 0)
            own = by_range[token_cuts[p] : token_cuts[p + 1]]
            own = own[place[where[own]] >= 0]
            if len(own):
                codes, back = np.unique(place[where[own]] * (self.vocabulary + 1) + words[own], return_inverse=True)
                keys = self._map(f"keys3-{p}", "<i8")
                at = np.searchsorted(keys, codes)
                at[at == len(keys)] = 0
                times[own] = np.where(keys[at] == codes, self._map(f"times3-{p}", kind)[at], 0)[back]
        totals[:] = known_totals[where]
        return totals, times

    def continuations(self, numbers: np.ndarray) -> np.ndarray:
        """In how many contexts each of ascending word numbers occurs."""
        out = np.zeros(len(numbers), np.int64)
        cuts = [0, *np.searchsorted(numbers, self.word_bounds).tolist(), len(numbers)]
        for q, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                first = int(self.word_bounds[q - 1]) if q else 0
                out[a:b] = self._map(f"seen-{q}", "<i8")[numbers[a:b] - first]
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and model score (log10) of each text."""
        hashes, lengths = token_hashes(texts)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        numbers, counts = self.words.lookup(distinct)
        base = np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))
        # the lower order, for the distinct words
        lower = np.full(len(distinct), self.lower_rest / (self.vocabulary + 1))
        known = numbers >= 0
        if known.any() and self.lower_total:
            seen = self.continuations(numbers[known])
            lower[known] += np.maximum(seen - self.lower[np.minimum(seen, 3)], 0) / self.lower_total
        starts = np.cumsum(lengths) - lengths
        word = numbers[inverse]
        context = np.concatenate(([-1], word[:-1]))
        context[starts] = self.vocabulary
        chance = lower[inverse]
        # contexts that were seen
        of, where = np.unique(context, return_inverse=True)
        totals = np.zeros((len(of), 4), np.int64)
        totals[of >= 0] = self.contexts(of[of >= 0])
        total = totals[where, 0]
        rest = (totals[:, 1:] @ self.discounts[1:])[where]
        pair = np.where((word >= 0) & (total > 0), context * (self.vocabulary + 1) + word, -1)
        keys, place = np.unique(pair, return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        times[keys >= 0] = self.bigram_counts(keys[keys >= 0])
        times = times[place]
        divisor = np.maximum(total, 1)
        chance = np.where(total > 0, np.maximum(times - self.discounts[np.minimum(times, 3)], 0) / divisor + rest / divisor * chance, chance)
        if self.order == 3:
            # the word before the context: start of text before the first, none before the start itself
            before = np.concatenate(([-1], context[:-1]))
            before[starts] = -1
            at = np.flatnonzero((before >= 0) & (context >= 0))
            totals, times = self.trigrams(before[at] * (self.vocabulary + 1) + context[at], word[at])
            seen = totals[:, 0] > 0
            at, totals, times = at[seen], totals[seen], times[seen]
            chance[at] = np.maximum(times - self.upper[np.minimum(times, 3)], 0) / totals[:, 0] + totals[:, 1:] @ self.upper[1:] / totals[:, 0] * chance[at]
        return lengths, np.add.reduceat((counts > 0)[inverse].astype(np.int64), starts), np.add.reduceat(base[inverse], starts), np.add.reduceat(np.log10(chance), starts)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more; each within 0 and its count."""
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    found = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return np.clip(found, 0.0, [0.0, 1.0, 2.0, 3.0])


def _count_words(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                found, times = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["h", "n"])

        for batch in batches:
            for _, _, texts in _texts(batch, 0, 4 * CHUNK):
                hashes, _ = token_hashes(texts)
                held.append(hashes)
                size += len(hashes)
                if size >= CHUNK:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of rows with the same first column, which arrive sorted by it."""
    now, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and keys[a] != now:
                yield int(now), held
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(now), held


def _write_words(counted: DataFrame, uri: str, top: int, grain: float, heavy: float) -> list:
    """Write the parts; returns for each its size and its words at every ``grain`` of token mass, and the heavy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _grouped(batches):
            hashes = np.concatenate([b.column(1).to_numpy().view(np.uint64) for b in held])
            counts = np.concatenate([b.column(2).to_numpy() for b in held])
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            store = Store(uri)
            store.write(f"words-{part}", hashes.astype("<u8"))
            store.write(f"counts-{part}", counts.astype("<i8"))
            steps = np.floor(np.cumsum(counts) / grain)
            cross = np.flatnonzero(np.diff(steps, prepend=0)) + 1
            large = np.flatnonzero(counts >= heavy)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([len(hashes)]), pa.array([cross.tolist()], pa.list_(pa.int64())), pa.array([large.tolist()], pa.list_(pa.int64())), pa.array([counts[large].tolist()], pa.list_(pa.int64()))],
                names=["part", "n", "cross", "large", "mass"],
            )

    part = F.shiftrightunsigned("h", 64 - top) if top else F.lit(0).cast("long")
    rows = counted.select(part.alias("part"), "h", "n").repartition(1 << top, "part").sortWithinPartitions("part")
    return rows.mapInArrow(run, "part long, n long, cross array<bigint>, large array<bigint>, mass array<bigint>").collect()


RUNS = "n int, p long, keys binary, words binary, times binary"


def _count_grams(rows: DataFrame, words: Words, vocabulary: int, bounds: np.ndarray, order: int) -> DataFrame:
    """Compressed runs (n, p, keys, words, times) of each chunk's distinct n-grams of the order in each range.

    ``keys`` are bigram numbers; ``words`` the last words of trigrams. With trigrams go the bigrams that begin texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last: list[np.ndarray] = []
        begins: list[np.ndarray] = []
        size = 0

        def cut(n: int, keys: np.ndarray, last: np.ndarray | None, times: np.ndarray) -> list[tuple]:
            cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
            return [(n, p, packed(keys[a:b]), None if last is None else packed_values(last[a:b]), zstandard.compress(times[a:b].astype("<u4").tobytes(), 1)) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            if order == 2:
                keys, times = np.unique(np.concatenate(held), return_counts=True)
                found = cut(2, keys, None, times)
            else:
                keys, ends, times = distinct_pairs(np.concatenate(held), np.concatenate(last), None, vocabulary + 1)
                found = cut(3, keys, ends, times) if len(keys) else []
                keys, times = np.unique(np.concatenate(begins), return_counts=True)
                found += cut(2, keys, None, times)
            held.clear(), last.clear(), begins.clear()
            columns = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["n", "p", "keys", "words", "times"])

        for batch in batches:
            for _, _, texts in _texts(batch, 0, 4 * CHUNK):
                hashes, lengths = token_hashes(texts)
                distinct, inverse = np.unique(hashes, return_inverse=True)
                word = words.lookup(distinct)[0][inverse]
                context = np.concatenate(([vocabulary], word[:-1]))
                starts = np.cumsum(lengths) - lengths
                context[starts] = vocabulary
                bigrams = context * (vocabulary + 1) + word
                if order == 2:
                    held.append(bigrams)
                else:
                    # a trigram ends at every token but the first of a text: the bigram that ends before it, and the token
                    inner = np.ones(len(word), bool)
                    inner[starts] = False
                    at = np.flatnonzero(inner)
                    held.append(bigrams[at - 1])
                    last.append(word[at])
                    begins.append(bigrams[starts])
                size += len(word)
                if size >= CHUNK:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows.select("text").mapInArrow(run, RUNS)


def _merge_trigrams(runs: DataFrame, uri: str, vocabulary: int, wide: bool, bounds: np.ndarray) -> DataFrame:
    """Write each range of trigrams; gives runs of the bigrams that end them, with the number of their contexts, and
    (n = 0) the counts of counts of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, kind = Store(uri), "<i8" if wide else "<u4"
        for p, held in _grouped(batches):
            keys = np.concatenate([unpacked(x.as_py()) for b in held for x in b.column(1)]).astype(np.int64)
            last = np.concatenate([unpacked_values(x.as_py()) for b in held for x in b.column(2)])
            times = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), "<u4") for b in held for x in b.column(3)]).astype(np.int64)
            keys, last, times = distinct_pairs(keys, last, times, vocabulary + 1)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            of = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(keys)]))))
            totals = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (times, times == 1, times == 2, times >= 3)], axis=1)
            store.write(f"contexts3-{p}", keys[first].astype("<i8"))
            store.write(f"totals3-{p}", totals.astype(kind))
            store.write(f"keys3-{p}", (of * (vocabulary + 1) + last).astype("<i8"))
            store.write(f"times3-{p}", times.astype(kind))
            ends, n = np.unique(keys % (vocabulary + 1) * (vocabulary + 1) + last, return_counts=True)
            cuts = [0, *np.searchsorted(ends, bounds).tolist(), len(ends)]
            found = [(2, q, packed(ends[a:b]), zstandard.compress(n[a:b].astype("<u4").tobytes(), 1), None) for q, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            found.append((0, p, None, None, [int((times == i).sum()) for i in (1, 2, 3, 4)]))
            columns = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["n", "p", "keys", "times", "numbers"])

    dealt = runs.filter("n = 3").select("p", "keys", "words", "times").repartition(len(bounds) + 1, "p").sortWithinPartitions("p")
    return materialise(dealt.mapInArrow(run, "n int, p long, keys binary, times binary, numbers array<bigint>"), "kn-trigrams")


def _merge_bigrams(runs: DataFrame, uri: str, vocabulary: int, wide: bool, heavy: list[int], word_bounds: np.ndarray, ranges: int) -> DataFrame:
    """Write each range; gives its counts of counts, the totals of cut contexts, and runs of words with their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(uri)
        for p, held in _grouped(batches):
            keys = np.concatenate([unpacked(x.as_py()) for b in held for x in b.column(1)]).astype(np.int64)
            times = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), "<u4") for b in held for x in b.column(2)]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, times = keys[starts], np.add.reduceat(times, starts)
            store.write(f"keys-{p}", keys.astype("<i8"))
            store.write(f"times-{p}", times.astype("<i8" if wide else "<u4"))
            context, word = keys // (vocabulary + 1), keys % (vocabulary + 1)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            totals = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (times, times == 1, times == 2, times >= 3)], axis=1)
            store.write(f"contexts-{p}", context[first].astype("<i8"))
            store.write(f"totals-{p}", totals.astype("<i8"))
            rows = [("counts", p, [int((times == i).sum()) for i in (1, 2, 3, 4)], None, None)]
            rows += [("heavy", int(context[first[i]]), totals[i].tolist(), None, None) for i in np.flatnonzero(np.isin(context[first], heavy))]
            seen, n = np.unique(word, return_counts=True)
            cuts = [0, *np.searchsorted(seen, word_bounds).tolist(), len(seen)]
            rows += [("seen", q, [], packed(seen[a:b]), zstandard.compress(n[a:b].astype("<i8").tobytes(), 1)) for q, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            kinds, at, values, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(at, pa.int64()), pa.array(values, pa.list_(pa.int64())), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["kind", "at", "numbers", "words", "times"])

    dealt = runs.repartition(ranges, "p").sortWithinPartitions("p")
    return materialise(dealt.mapInArrow(run, "kind string, at long, numbers array<bigint>, words binary, times binary"), "kn-ranges")


def _sum_continuations(merged: DataFrame, uri: str, vocabulary: int, word_bounds: np.ndarray) -> list:
    edges = [0, *word_bounds.tolist(), vocabulary]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, held in _grouped(batches):
            total = np.zeros(edges[q + 1] - edges[q], np.int64)
            for b in held:
                for words, times in zip(b.column(1), b.column(2), strict=True):
                    total[unpacked(words.as_py()).astype(np.int64) - edges[q]] += np.frombuffer(zstandard.decompress(times.as_py()), "<i8")
            Store(uri).write(f"seen-{q}", total.astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([int(total.sum())]), pa.array([[int((total == i).sum()) for i in (1, 2, 3, 4)] + [int((total >= 3).sum())]], pa.list_(pa.int64()))], names=["total", "counts"])

    rows = merged.filter("kind = 'seen'").select(F.col("at").alias("q"), "words", "times").repartition(len(edges) - 1, "q").sortWithinPartitions("q")
    return rows.mapInArrow(run, "total long, counts array<bigint>").collect()


def train(docs: DataFrame, order: int = 2, range_tokens: int = RANGE, part_words: int = PART) -> Model:
    """Count and store the model of all texts of ``docs``, of bigrams (``order`` 2) or trigrams (3).

    Null and empty texts are one end token each, repeated rows count each, a
    text of any length counts whole, an empty table gives a model that knows
    no word; columns besides text are not looked at whatever their names.
    """
    if order not in (2, 3):
        raise ValueError(f"order {order}: 2 and 3 are counted")
    rows = pick(docs, "text")
    uri = f"{run_dir(docs.sparkSession)}/kneser-ney"
    counted = materialise(_count_words(rows), "kn-words")
    tokens, vocabulary = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if vocabulary > MOST_WORDS:
        raise OverflowError(f"{vocabulary} distinct words: bigrams of more than {MOST_WORDS} have no 63-bit numbers")
    top = max(0, (vocabulary // part_words).bit_length())
    share = max(1.0, tokens / min(MOST_RANGES, max(1, -(-tokens // range_tokens))))
    found = {r.part: r for r in _write_words(counted, uri, top, share / 4, share)} if vocabulary else {}
    offsets = np.cumsum([0] + [found[p].n if p in found else 0 for p in range(1 << top)]).tolist()
    words = Words(uri, top, offsets)
    cross = sorted({offsets[p] + c for p, r in found.items() for c in r.cross} - {vocabulary})
    heavy = {offsets[p] + i: m for p, r in found.items() for i, m in zip(r.large, r.mass, strict=True)}
    word_bounds = np.array(cross[3::4], np.int64)
    # the start of text is a context of as many tokens as there are texts; it and heavy contexts are cut inside too
    starts = rows.count()
    if starts >= share:
        heavy[vocabulary] = starts
    edges = {c * (vocabulary + 1) for c in cross[3::4]} | {vocabulary * (vocabulary + 1)} | {(h + i) * (vocabulary + 1) for h in heavy for i in (0, 1) if 0 < h + i <= vocabulary}
    for h, mass in heavy.items():
        pieces = int(mass // share) + 1
        edges |= {h * (vocabulary + 1) + cross[len(cross) * i // pieces] for i in range(1, pieces) if cross}
    bounds = np.array(sorted(edges) if vocabulary else [], np.int64)
    if not vocabulary:
        return Model(words, 0, 0, bounds, frozenset(), {}, word_bounds, discounts(0, 0, 0, 0), discounts(0, 0, 0, 0), 0, 1.0, order, discounts(0, 0, 0, 0))
    grams = _count_grams(rows, words, vocabulary, bounds, order)
    upper, filled3 = None, set()
    if order == 2:
        runs = grams.select("p", "keys", "times")
    else:
        grams = materialise(grams, "kn-runs")
        ended = _merge_trigrams(grams, uri, vocabulary, bool(tokens >> 32), bounds)
        runs = ended.filter("n = 2").select("p", "keys", "times").unionByName(grams.filter("n = 2").select("p", "keys", "times"))
        of3 = np.zeros(4, np.int64)
        for row in ended.filter("n = 0").select("p", "numbers").toLocalIterator():
            of3 += np.array(row.numbers)
            filled3.add(row.p)
        upper = discounts(*of3.tolist())
    merged = _merge_bigrams(runs, uri, vocabulary, bool(tokens >> 32), sorted(heavy), word_bounds, max(1, len(bounds) + 1))
    of = np.zeros(4, np.int64)
    cut: dict[int, np.ndarray] = {}
    filled = set()
    for row in merged.filter("kind <> 'seen'").select("kind", "at", "numbers").toLocalIterator():
        if row.kind == "counts":
            of += np.array(row.numbers)
            filled.add(row["at"])
        else:
            cut[row["at"]] = cut.get(row["at"], 0) + np.array(row.numbers)
    sums = _sum_continuations(merged, uri, vocabulary, word_bounds)
    total = sum(r.total for r in sums)
    n1, n2, n3, n4, more = np.sum([r.counts for r in sums], axis=0).tolist()
    lower = discounts(n1, n2, n3, n4)
    rest = float(lower[1] * n1 + lower[2] * n2 + lower[3] * more) / total
    return Model(words, tokens, vocabulary, bounds, frozenset(filled), cut, word_bounds, discounts(*of.tolist()), lower, total, rest, order, upper, frozenset(filled3))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of ``docs``."""
    frame = pick(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    schema = f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, texts in _texts(batch, 1, 4 * SCORED):
                tokens, known, base, score = model.score(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(tokens), pa.array(known), pa.array(np.full(b - a, model.tokens)), pa.array(base), pa.array(score), pa.array(10 ** (-score / tokens))], names=names
                )

    return frame.mapInArrow(run, schema)


def score_held_out(docs: DataFrame, folds: int = 5, fold: int = 1, order: int = 2) -> DataFrame:
    """Train on the rows whose crc32 leaves another remainder than ``fold``, score all rows.

    Columns: doc_id, held_out and those of ``score_texts``. Null and empty
    texts are one end token; a null id counts as an empty text; repeated rows
    are learned and scored each, ties get equal scores; a text of any length
    is scored whole; columns besides doc_id and text are not looked at
    whatever their names; with nothing to learn from all tokens are unknown
    and equally likely; an empty table gives no rows.
    """
    model = train(pick(docs, "doc_id", "text").filter(training(folds, fold)), order)
    return score_texts(docs, model).withColumn("held_out", ~training(folds, fold))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_held_out(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
