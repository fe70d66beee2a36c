"""SentencePiece encoding without replacement, and decoding.

The pieces of the model span a lattice over each text; its paths are the
text's segmentations, weighted by the pieces. Distinct segmentations are
drawn by Gumbel top-k: the root of the search carries the largest of the
perturbed log-probabilities, and a partial path carries the largest of all
paths that begin with it. A* pops the node with the largest perturbed value;
the heuristic is exact, because the backward sums of the lattice give the
mass of what follows. A popped node is expanded down its argmax child, drawn
in proportion to the mass, which inherits the value; the siblings it leaves
stay one unexpanded frontier node with their joint mass and a Gumbel value
truncated below the parent's. Expanding such a node draws among the siblings
that are left. So the k largest come out in order and without repeats, and
the value of the next one gives the inclusion scores.

No piece crosses from a non-space to a space or over a line feed, so the
lattice of a text is a chain of cells (a word with the spaces before it).
Cells are the same in many places; a chunk of texts computes the lattice of
each distinct cell once, all of them together, and walks all texts together.
Random numbers are hashes of the row key, the rank of the path and the place
in the text, so they don't depend on how rows are batched.

The model's pieces carry merge ranks, not probabilities. The weight of the
piece of rank r is taken as 1 / (r + 2) over the sum of all (Zipf's law).
Characters without a piece of their own become byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, pick, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LITERAL = "\ud800"  # stands for a U+2581 of the text itself, which is not a space
CELL = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
SHORT = 48  # longest cell computed together with others
SCALE = 2.0  # log weight given back for each character, so that sums stay in range
CHUNK = 1_200_000  # characters worked on together; some 150 MB of arrays
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = x + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from hashes."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def row_seed(key: object, text: str, seed: int) -> int:
    """Of the row key; of the text where there is no key."""
    name = f"={key}" if key is not None else f"?{text}"
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), seed)


class Pieces:
    """The vocabulary as a trie and as weights."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        normal = []
        self.output = [b""] * n
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.output[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append(i)
                self.output[i] = piece.replace(SPACE, " ").encode()
        weights = 1.0 / (np.arange(len(normal)) + 2.0)
        total = weights.sum() + 1.0 / (len(normal) + 2.0)
        self.weight = np.zeros(n)
        self.weight[normal] = weights / total
        letters = sorted({c for i in normal for c in self.text[i]})
        self.letters = {c: k for k, c in enumerate(letters)}
        self.classes = np.full(0x110000, len(letters), np.int32)
        self.classes[[ord(c) for c in letters]] = np.arange(len(letters))
        self.width = len(letters) + 1
        children: list[dict[int, int]] = [{}]
        ends, gains = [-1], [0.0]
        lift = np.exp(SCALE)
        for i in normal:
            state = 0
            for c in self.text[i]:
                k = self.letters[c]
                if k not in children[state]:
                    children[state][k] = len(children)
                    children.append({})
                    ends.append(-1)
                    gains.append(0.0)
                state = children[state][k]
            ends[state], gains[state] = i, self.weight[i] * lift ** len(self.text[i])
        self.children = children
        self.ends = np.array(ends, np.int32)
        self.gains = np.array(gains)  # the lifted weight of the piece that ends there, 0 for none
        # the moves, in an open hash table with linear probing
        bits = max(8, len(children).bit_length() + 3)
        self.shift = U(64 - bits)
        self.move_keys = np.full((1 << bits) + 64, -1, np.int64)
        self.move_to = np.zeros(len(self.move_keys), np.int32)
        moves = [(s * self.width + k, t) for s, next_ in enumerate(children) for k, t in next_.items()]
        slots = self._slots(np.array([k for k, _ in moves], np.int64)).tolist()
        for (key, to), slot in zip(moves, slots, strict=True):
            while self.move_keys[slot] >= 0:
                slot += 1
            self.move_keys[slot], self.move_to[slot] = key, to
        self.first = np.zeros(self.width, np.int32)
        for k, t in children[0].items():
            self.first[k] = t
        self.longest = max(len(self.text[i]) for i in normal)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U) * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def moved(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is none."""
        keys = state.astype(np.int64) * self.width + letter
        slot = self._slots(keys)
        found = self.move_keys.take(slot)
        hit = found == keys
        out = self.move_to.take(slot) * hit
        open_ = np.flatnonzero(~hit & (found >= 0))
        while len(open_):
            slot[open_] += 1
            found = self.move_keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.move_to[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    @cached_property
    def outputs(self) -> pa.LargeBinaryArray:
        return pa.array(self.output, pa.large_binary())

    @cached_property
    def byte_of(self) -> dict[str, np.ndarray]:
        return {}

    def bytes_for(self, char: str) -> np.ndarray:
        if char not in self.byte_of:
            raw = SPACE.encode() if char == LITERAL else char.encode("utf-8", "surrogatepass")
            self.byte_of[char] = self.byte_ids[list(raw)]
        return self.byte_of[char]

    def decode(self, ids: list[int]) -> str:
        """The text: pieces joined, byte pieces read as UTF-8, the space put before the text taken off."""
        raw = b"".join(map(self.output.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")

    def decodes_to(self, ids: list[np.ndarray], raws: list[bytes]) -> list[bool]:
        """Whether each row of ids decodes to the text with the given UTF-8, all rows together."""
        if not ids:
            return []
        joined = self.outputs.take(pa.array(np.concatenate(ids)))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)
        bounds = offsets[np.cumsum([0] + [len(x) for x in ids])].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        own = (data[begin:end].tobytes() for begin, end in zip(bounds[:-1], bounds[1:], strict=True))
        return [(x[1:] if x[:1] == b" " else x) == raw for x, raw in zip(own, raws, strict=True)]

    def decode_any(self, ids: list[int | None]) -> tuple[str, bool]:
        """The text of any row of ids, and whether some of it had to be left out or replaced."""
        known = [i for i in ids if i is not None and 0 <= i < len(self.output)]
        raw = b"".join(map(self.output.__getitem__, known))
        raw = raw[1:] if raw[:1] == b" " else raw
        try:
            return raw.decode("utf-8"), len(known) < len(ids)
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace"), True


_LOADED: dict[str, Pieces] = {}


def pieces_at(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def cells_of(text: str) -> list[str]:
    if not text:
        return []
    marked = text.replace(SPACE, LITERAL) if SPACE in text else text
    return CELL.findall(SPACE + marked.replace(" ", SPACE))


def cut(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``cells_of`` for all texts together, given as UTF-8.

    Returns the number of cells of each text, the distinct cell at each place,
    and the code points of the distinct cells, one after another, with their lengths.
    """
    data = b"".join([b" " + raw for raw in raws if raw])
    if not data:
        return np.zeros(len(raws), np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    bounds = np.cumsum([0] + [len(raw) + 1 if raw else 0 for raw in raws])
    byte = np.frombuffer(data, np.uint8)
    space, feed = byte == 0x20, byte == 0x0A
    begins = feed.copy()
    begins[1:] |= feed[:-1]
    begins[1:] |= space[1:] & ~space[:-1]
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    offsets = np.append(np.flatnonzero(begins), len(data))
    counts = np.diff(np.searchsorted(offsets[:-1], bounds))
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    distinct = every.dictionary
    begin = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
    data = distinct.buffers()[2].to_pybytes()[: begin[-1]]
    lengths = np.add.reduceat((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, begin[:-1], dtype=np.int64)
    points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[points == ord(SPACE)] = ord(LITERAL)
    points[points == 0x20] = ord(SPACE)
    return counts, every.indices.to_numpy().astype(np.int64), points, lengths


class Lattice:
    """The edges of all distinct cells of a chunk, sorted by node, longest first.

    A node is a cell and the number r of characters still to be covered.
    """

    def __init__(self, pieces: Pieces, points: np.ndarray, lengths: np.ndarray) -> None:
        self.pieces = pieces
        cell_stops = np.cumsum(lengths)
        order = np.argsort(-lengths, kind="stable")
        long = int((lengths > SHORT).sum())
        self.lengths = lengths
        self.rank = np.empty(len(lengths), np.int64)
        self.rank[order[long:]] = np.arange(len(lengths) - long)
        self.long_base = np.full(len(lengths), -1, np.int64)
        self.any_long = long > 0
        short = order[long:]
        sizes = lengths[short]
        most = int(sizes[0]) if len(short) else 0
        counts = [int(np.searchsorted(-sizes, -r, "right")) for r in range(most + 1)]
        self.base = np.concatenate(([0, 0], np.cumsum(counts[1:]))) if most else np.zeros(2, np.int64)
        stops = cell_stops[short]  # in the code points, longest cell first; characters r from the end
        self.extra: list[np.ndarray] = []  # ids of byte edges of several bytes
        node_parts, edge_piece, edge_step, edge_weight = [], [], [], []
        beta = [np.ones(len(short))]
        chars: list[np.ndarray] = [np.zeros(0, np.int32)]
        for r in range(1, most + 1):
            n = counts[r]
            code = points[stops[:n] - r]
            chars.append(pieces.classes[code])
            total = np.zeros(n)
            found = []
            at = np.arange(n)
            state = pieces.first[chars[r]]
            for step in range(1, min(r, pieces.longest) + 1):
                if step > 1:
                    state = pieces.moved(state, chars[r - step + 1].take(at))
                live = np.flatnonzero(state)
                at, state = at.take(live), state.take(live)
                if not len(at):
                    break
                gain = pieces.gains.take(state)
                is_end = np.flatnonzero(gain)
                if len(is_end):
                    where = at.take(is_end)
                    value = gain.take(is_end) * beta[r - step].take(where)
                    total[where] += value
                    found.append((where, pieces.ends.take(state.take(is_end)), step, value))
            single = np.zeros(n, bool)
            for where, _, step, _ in found:
                if step == 1:
                    single[where] = True
            if not single.all():
                where = np.flatnonzero(~single)
                value = beta[r - 1][where].copy()
                total[where] += value
                found.append((where, self._byte_pieces(code[where]), 1, value))
            beta.append(total)
            found.reverse()
            where = np.concatenate([f[0] for f in found])
            arranged = np.argsort(where, kind="stable")
            node_parts.append(self.base[r] + where[arranged])
            edge_piece.append(np.concatenate([f[1] for f in found])[arranged])
            edge_step.append(np.concatenate([np.full(len(f[0]), f[2], np.int64) for f in found])[arranged])
            edge_weight.append((np.concatenate([f[3] for f in found]) / total[where])[arranged])
        nodes = int(self.base[most + 1]) if most else 0
        for i in order[:long]:
            self.long_base[i] = nodes
            cell = "".join(map(chr, points[cell_stops[i] - lengths[i] : cell_stops[i]].tolist()))
            for node, piece, step, share in self._long_cell(cell, nodes):
                node_parts.append(node)
                edge_piece.append(piece)
                edge_step.append(step)
                edge_weight.append(share)
            nodes += len(cell)
        if not node_parts:
            node_parts, edge_piece, edge_step, edge_weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        node = np.concatenate(node_parts)
        self.edge_piece = np.concatenate(edge_piece).astype(np.int32)
        self.edge_step = np.concatenate(edge_step)
        self.share = np.concatenate(edge_weight)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(node, minlength=nodes))))

    def _byte_pieces(self, codes: np.ndarray) -> np.ndarray:
        """The byte piece of each character; those of several bytes are noted, as -1 - their place in the notes."""
        out = np.empty(len(codes), np.int64)
        distinct, inverse = np.unique(codes, return_inverse=True)
        for k, code in enumerate(distinct.tolist()):
            ids = self.pieces.bytes_for(chr(code))
            if len(ids) == 1:
                value = int(ids[0])
            else:
                self.extra.append(ids)
                value = -len(self.extra)
            out[inverse == k] = value
        return out

    def _long_cell(self, cell: str, first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The edges of a long cell, one node after another from the last character on, in logarithms."""
        from math import exp, log

        pieces = self.pieces
        log_weight = np.log(np.maximum(pieces.weight, 1e-300)).tolist()
        ends, letters, children = pieces.ends.tolist(), pieces.letters, pieces.children
        n = len(cell)
        beta = [0.0] * (n + 1)  # by the number of characters left
        byte_code: dict[str, int] = {}
        nodes, found, steps, shares = [], [], [], []
        for r in range(1, n + 1):
            begin = n - r
            state, own = 0, []
            for step in range(1, min(r, pieces.longest) + 1):
                state = children[state].get(letters.get(cell[begin + step - 1], -1), 0)
                if not state:
                    break
                if ends[state] >= 0:
                    own.append((log_weight[ends[state]] + beta[r - step], ends[state], step))
            if not own or own[0][2] != 1:
                char = cell[begin]
                if char not in byte_code:
                    byte_code[char] = int(self._byte_pieces(np.array([ord(char)]))[0])
                own.append((beta[r - 1], byte_code[char], 1))
            top = max(o[0] for o in own)
            beta[r] = top + log(sum(exp(o[0] - top) for o in own))
            for value, piece, step in reversed(own):
                nodes.append(first + r - 1)
                found.append(piece)
                steps.append(step)
                shares.append(exp(value - beta[r]))
        yield np.array(nodes, np.int64), np.array(found, np.int64), np.array(steps, np.int64), np.array(shares)

    def node(self, cell: np.ndarray, left: np.ndarray) -> np.ndarray:
        if not self.any_long:
            return self.base[left] + self.rank[cell]
        base = self.long_base[cell]
        return np.where(base >= 0, base + left - 1, self.base[np.minimum(left, len(self.base) - 1)] + self.rank[cell])

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, in proportion to the mass behind it."""
        edge = self.start.take(node)
        last = self.start.take(node + 1) - 1
        rest = u - self.share.take(edge)
        at, now = np.arange(len(edge)), edge
        more = np.flatnonzero((rest > 0) & (now < last))
        while len(more):
            at, now, last, rest = at.take(more), now.take(more) + 1, last.take(more), rest.take(more)
            edge[at] = now
            rest -= self.share.take(now)
            more = np.flatnonzero((rest > 0) & (now < last))
        return edge

    def walk(self, cell: np.ndarray, left: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
        """Draw paths through all given cells, from ``left`` characters on.

        Returns, in order, the place in ``cell`` of each step, its node, its
        edge and the characters left before it.
        """
        drawn = []
        at = np.flatnonzero(left > 0)
        left = left[at].astype(np.int64)
        cells, keys = cell[at], key[at]
        count = np.zeros(len(cell), np.int64)
        while len(at):
            node = self.node(cells, left)
            edge = self.draw(node, uniform(mixed(keys ^ left.astype(U))))
            drawn.append((at, node, edge, left))
            count[at] = len(drawn)
            left = left - self.edge_step.take(edge)
            more = np.flatnonzero(left)
            at, left, cells, keys = at.take(more), left.take(more), cells.take(more), keys.take(more)
        offset = np.cumsum(count) - count
        total = int(count.sum())
        out = tuple(np.empty(total, np.int64) for _ in range(4))
        for step, parts in enumerate(drawn):
            slot = offset.take(parts[0]) + step
            for whole, part in zip(out, parts, strict=True):
                whole[slot] = part
        return out


def truncated(loc: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values with the given locations, all below ``top``."""
    value = loc - np.log(-np.log(u))
    near = np.flatnonzero(value > top - 40)  # further below, the bound changes nothing
    value[near] = np.minimum(-np.logaddexp(-top[near], -value[near]), top[near])
    return value


class Paths:
    """The new steps of one round's paths: from the branching point of each text on."""

    def __init__(self, doc: np.ndarray, place: np.ndarray, node: np.ndarray, edge: np.ndarray, before: np.ndarray, rest: np.ndarray, taken: list[tuple[int, ...]] | None) -> None:
        self.doc, self.place, self.node, self.edge = doc, place, node, edge
        self.before = before  # log-probability of what comes before each step
        self.rest = rest  # value of the siblings left at each step
        self.taken = taken or {}  # step -> edges drawn there by earlier paths


class Sampler:
    """Draws ``samples`` segmentations of each text of a chunk."""

    def __init__(self, pieces: Pieces, raws: list[bytes], seeds: list[int], samples: int) -> None:
        self.pieces, self.samples = pieces, samples
        self.n_cells, self.cell, points, lengths = cut(raws)
        self.lattice = Lattice(pieces, points, lengths)
        self.first = np.cumsum(self.n_cells) - self.n_cells
        self.doc = np.repeat(np.arange(len(raws)), self.n_cells)
        self.number = np.arange(len(self.cell)) - self.first[self.doc] if len(self.cell) else np.zeros(0, np.int64)
        self.seeds = np.array(seeds, U)

    def _keys(self, rank: int, places: np.ndarray, salt: int) -> np.ndarray:
        base = mixed(self.seeds ^ mixed(np.array([rank * 4 + salt], U)))
        return mixed(base[self.doc[places]] + (self.number[places].astype(U) << U(32)))

    def _values(self, rank: int, doc: np.ndarray, place: np.ndarray, left: np.ndarray, before: np.ndarray, mass: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Values of the siblings left at each step: their joint mass under the value of the path."""
        with np.errstate(divide="ignore"):
            loc = before + np.log(np.maximum(mass, 0.0))
        loc[mass < 1e-12] = -np.inf  # nothing but rounding is left
        u = uniform(mixed(self._keys(rank, place, 1) ^ left.astype(U)))
        return truncated(loc, top[doc], u)

    def run(self) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        """Rank, texts, edges of their paths, log-probability, perturbed value; yields a round at a time.

        The last element is the value of the next path of each text, -inf where there is none.
        """
        n = len(self.n_cells)
        lat = self.lattice
        with np.errstate(divide="ignore"):
            log_share = np.log(lat.share)
        self.below = np.concatenate(([0.0], np.cumsum(lat.share)))
        top = -np.log(-np.log(uniform(mixed(self.seeds ^ U(0x5851F42D4C957F2D)))))
        live = np.arange(n)
        place, node, edge, left = lat.walk(self.cell, lat.lengths[self.cell], self._keys(0, np.arange(len(self.cell)), 0))
        doc = self.doc[place]
        sizes = np.bincount(doc, minlength=n)
        starts = np.cumsum(sizes) - sizes
        before, end = self._cumulated(log_share[edge], starts, sizes)
        rest = self._values(0, doc, place, left, before, 1.0 - lat.share[edge], top)
        frontier = [Paths(doc, place, node, edge, before, rest, None)]
        full = np.split(edge, starts[1:]) if n else []
        for rank in range(self.samples):
            if rank:
                live = live[np.isfinite(following[live])]
                if not len(live):
                    return
                top = following
                full, end, new = self._branch(rank, live, best, top, frontier, log_share)
                frontier.append(new)
            best, following = self._best(frontier, n)
            yield rank, live, full, end, top[live], following[live]

    @staticmethod
    def _cumulated(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums before each step and after the last, within each run, on top of ``first``."""
        before, end = np.zeros(len(values)), np.zeros(len(starts))
        first = np.zeros(len(starts)) if first is None else first
        for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):  # one run at a time: the sums of a text don't depend on others
            if n:
                after = np.cumsum(values[a : a + n])
                after += first[i]
                before[a], before[a + 1 : a + n], end[i] = first[i], after[:-1], after[-1]
        return before, end

    @staticmethod
    def _best(frontier: list[Paths], n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text the frontier node with the largest value, as (paths, step), and that value."""
        value, found = np.full(n, -np.inf), np.full((n, 2), -1, np.int64)
        for k, paths in enumerate(frontier):
            if not len(paths.doc):
                continue
            starts = np.flatnonzero(np.concatenate(([True], paths.doc[1:] != paths.doc[:-1])))
            highest = np.maximum.reduceat(paths.rest, starts)
            owner = paths.doc[starts]
            sizes = np.diff(np.concatenate((starts, [len(paths.doc)])))
            is_top = np.flatnonzero(paths.rest == np.repeat(highest, sizes))
            where, first = np.unique(paths.doc[is_top], return_index=True)
            better = highest > value[owner]
            at = np.zeros(n, np.int64)
            at[where] = is_top[first]
            value[owner[better]] = highest[better]
            found[owner[better], 0] = k
            found[owner[better], 1] = at[owner[better]]
        return found, value

    def _branch(self, rank: int, live: np.ndarray, best: np.ndarray, top: np.ndarray, frontier: list[Paths], log_share: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, Paths]:
        """Expand the best node of each text: draw among the siblings left there, then on to the end."""
        lat = self.lattice
        n = len(live)
        at_place, at_node, at_before = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        taken = np.full((n, rank), -1, np.int64)  # edges drawn there before, ascending, -1 for none
        for k, paths in enumerate(frontier):
            own = np.flatnonzero(best[live, 0] == k)
            step = best[live[own], 1]
            at_place[own], at_node[own], at_before[own] = paths.place[step], paths.node[step], paths.before[step]
            paths.rest[step] = -np.inf
            taken[own, -1] = paths.edge[step]
            for i, t in zip(own.tolist(), step.tolist(), strict=True):
                if t in paths.taken:
                    taken[i, rank - len(paths.taken[t]) :] = paths.taken[t]
        taken.sort(axis=1)
        at_mass = 1.0 - np.where(taken >= 0, lat.share[taken], 0.0).sum(axis=1)
        # a point of the open mass, moved past the taken edges that lie before it
        at_left = self._left(at_place, at_node)
        point = uniform(mixed(self._keys(rank, at_place, 2) ^ at_left.astype(U))) * at_mass
        for column in range(rank):
            edge = taken[:, column]
            ahead = np.where(edge >= 0, self.below[edge] - self.below[lat.start[at_node]], np.inf)
            point += np.where(point >= ahead, lat.share[edge], 0.0)
        at_edge = lat.draw(at_node, point)
        for i in np.flatnonzero((taken == at_edge[:, None]).any(axis=1)).tolist():  # by rounding only
            at_edge[i] = next(e for e in range(lat.start[at_node[i]], lat.start[at_node[i] + 1]) if e not in taken[i])
        at_mass -= lat.share[at_edge]
        taken_now = [tuple(sorted([e for e in row if e >= 0] + [new])) for row, new in zip(taken.tolist(), at_edge.tolist(), strict=True)]
        # what is left of the cell at the branch, then the cells after it
        left = at_left - lat.edge_step[at_edge]
        counts = self.first[live] + self.n_cells[live] - at_place
        places = np.repeat(at_place - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        remaining = lat.lengths[self.cell[places]].copy()
        remaining[np.cumsum(counts) - counts] = left
        where, node, edge, still = lat.walk(self.cell[places], remaining, self._keys(rank, places, 0))
        place = places[where]
        owner = np.repeat(np.arange(n), counts)[where]
        # the branching step goes before the drawn ones
        sizes = np.bincount(owner, minlength=n)
        slots = np.arange(len(owner)) + owner + 1
        heads = np.cumsum(sizes + 1) - (sizes + 1)
        total = len(owner) + n
        joined = []
        for head, tail in ((at_place, place), (at_node, node), (at_edge, edge), (at_left, still)):
            both = np.empty(total, np.int64)
            both[heads], both[slots] = head, tail
            joined.append(both)
        place, node, edge, still = joined
        owner = np.repeat(np.arange(n), sizes + 1)
        before, end = self._cumulated(log_share[edge], heads, sizes + 1, at_before)
        mass = 1.0 - lat.share[edge]
        mass[heads] = at_mass
        rest = self._values(rank, live[owner], place, still, before, mass, top)
        new = Paths(live[owner], place, node, edge, before, rest, None)
        new.taken = dict(zip(heads.tolist(), taken_now, strict=True))
        new.origin = {int(d): tuple(best[d]) for d in live}
        new.heads = dict(zip(live.tolist(), heads.tolist(), strict=True))
        new.stops = dict(zip(live.tolist(), (heads + sizes + 1).tolist(), strict=True))
        full = [np.concatenate((self._before(frontier, *best[d]), edge[heads[i] : heads[i] + sizes[i] + 1])) for i, d in enumerate(live.tolist())]
        return full, end, new

    def _before(self, frontier: list[Paths], k: int, step: int) -> np.ndarray:
        """The edges of the path up to a step."""
        paths = frontier[k]
        doc = int(paths.doc[step])
        if not k:
            start = int(np.searchsorted(paths.doc, doc))
            return paths.edge[start:step]
        head = paths.heads[doc]
        return np.concatenate((self._before(frontier, *paths.origin[doc]), paths.edge[head:step]))

    def _left(self, place: np.ndarray, node: np.ndarray) -> np.ndarray:
        """How many characters of its cell a node still has to cover."""
        lat = self.lattice
        cell = self.cell[place]
        short = np.searchsorted(lat.base[1:], node, "right")
        return np.where(lat.long_base[cell] >= 0, node - lat.long_base[cell] + 1, short) if lat.any_long else short

    def ids(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of each path, given by its edges."""
        if not paths:
            return []
        found = self.lattice.edge_piece[np.concatenate(paths)]
        stops = np.cumsum([len(p) for p in paths])
        several = np.flatnonzero(found < 0)
        if len(several):
            extra = self.lattice.extra
            sizes = np.ones(len(found), np.int64)
            sizes[several] = np.array([len(x) for x in extra])[-1 - found[several]]
            ends = np.cumsum(sizes)
            which, found = found[several], np.repeat(found, sizes)
            for note in np.unique(which).tolist():
                own = extra[-1 - note]
                found[(ends[several[which == note]] - len(own))[:, None] + np.arange(len(own))] = own
            stops = np.concatenate(([0], ends))[stops]
        return np.split(found, stops[:-1])


def inclusion(log_prob: np.ndarray, next_value: np.ndarray) -> np.ndarray:
    """Log-probability that a segmentation is among the drawn ones, given the value of the next: log(1 - exp(-exp(p - k)))."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        x = log_prob - next_value
        y = np.exp(x)
        out = np.where(x < -10, x - y / 2 + y * y / 24, np.log(-np.expm1(-y)))
    return np.where(np.isneginf(next_value), 0.0, out)


def sample_chunk(pieces: Pieces, keys: list[object], texts: list[str], samples: int, seed: int) -> list[tuple]:
    """(place in the chunk, rank, ids, log-probability, perturbed value, inclusion, whether it decodes to the text)."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    sampler = Sampler(pieces, raws, [row_seed(k, t, seed) for k, t in zip(keys, texts, strict=True)], samples)
    rounds = list(sampler.run())
    last = np.full(len(texts), -np.inf)
    for _, live, _, _, _, following in rounds:
        last[live] = following
    drawn = np.bincount(np.concatenate([r[1] for r in rounds]), minlength=len(texts)) if rounds else np.zeros(0)
    last[drawn < samples] = -np.inf  # all segmentations came out
    out = []
    for rank, live, full, end, value, _ in rounds:
        ids, docs = sampler.ids(full), live.tolist()
        scores = (map(round, x.tolist(), repeat(9)) for x in (end, value, inclusion(end, last[live])))
        out += zip(docs, repeat(rank + 1), ids, *scores, pieces.decodes_to(ids, [raws[d] for d in docs]))
    out.sort(key=lambda row: row[:2])
    return out


def _chunk_rows(pieces: Pieces, ids_of: pa.Array, texts: list[str], samples: int, seed: int) -> pa.RecordBatch:
    rows = sample_chunk(pieces, ids_of.to_pylist(), texts, samples, seed)
    ids = [r[2] for r in rows]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [
            ids_of.take(pa.array([r[0] for r in rows], pa.int64())),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())),
            *(pa.array([r[c] for r in rows], pa.float64()) for c in (3, 4, 5)),
            pa.array([r[6] for r in rows], pa.bool_()),
        ],
        names=["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"],
    )


def sample_segmentations(docs: DataFrame, samples: int = 2, seed: int = 0, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``samples`` distinct segmentations of each text, largest perturbed log-probability first.

    Columns: doc_id, sample (from 1), ids, log_prob (of the segmentation given
    the text), perturbed, log_inclusion (that a draw of as many holds it) and
    round_trip (the ids decode to the text). Texts with fewer segmentations
    give them all, with log_inclusion 0. Null and empty texts have one, of no
    pieces. Rows with equal key and text give equal rows; a row without a key
    is seeded by its text; ties of the perturbed values don't occur but by
    equal paths, which come out once; a text of any length is sampled whole;
    columns besides doc_id and text are not looked at whatever their names; an
    empty table gives no rows. ``decode_ids`` gives the texts back. Texts are
    worked on together until they have ``chunk`` characters: fewer take less
    memory and somewhat more time, for the same rows.
    """
    frame = pick(docs, "doc_id", "text")
    schema = f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_at(model)
        for batch in batches:
            start, size, texts = 0, 0, []
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or size >= chunk:
                    if texts:
                        yield _chunk_rows(pieces, batch.column(0).slice(start, i - start), texts, samples, seed)
                    start, size, texts = i, 0, []
                if i < batch.num_rows:
                    texts.append(batch.column(1)[i].as_py() or "")
                    size += len(texts[-1])
        give_back()

    return frame.mapInArrow(run, schema)


def decode_ids(frame: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of ``frame``, which has a column ids (array of int), with two more: decoded and broken.

    ``decoded`` is the text that the ids stand for: pieces joined, byte pieces
    read as UTF-8, the space put before the text taken off. Bytes that are not
    whole UTF-8 become U+FFFD each, ids outside the vocabulary and null ids
    stand for nothing, and ``broken`` says whether either occurred. Null ids
    (no array) give a null text, an empty array an empty one, neither broken.
    Rows of any length are decoded whole, repeated rows each; an empty table
    gives no rows; other columns pass, unless they are named decoded or broken.
    """
    columns = frame.columns
    plain = frame.toDF(*[f"_c{i}" for i in range(len(columns))])
    at = columns.index("ids")
    schema = T.StructType([*plain.schema.fields, T.StructField("decoded", T.StringType()), T.StructField("broken", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_at(model)
        for batch in batches:
            found = [(None, False) if ids.as_py() is None else pieces.decode_any(ids.as_py()) for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.bool_())], names=schema.names)

    out = plain.mapInArrow(run, schema)
    kept = [(i, name) for i, name in enumerate(columns) if name not in ("decoded", "broken")]
    return out.select(*[F.col(f"_c{i}").alias(name) for i, name in kept], "decoded", "broken")


def digests(sampled: DataFrame) -> DataFrame:
    """The segmentations with the number and a hash of their ids; null and repeated rows give rows like others."""
    return sampled.select("doc_id", "sample", "ids", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "log_inclusion", "round_trip")


def op1_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(sample_segmentations(table(spark, sf_dir, "documents")))
