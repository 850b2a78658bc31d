"""Sampled segmentations of text over the lattice of a SentencePiece model's pieces."""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .textkit import mix

_STEP = 0x9E3779B97F4A7C15
#: Between texts stands a byte that no piece holds.
_WALL = 0xFF
#: Bytes that are worked on at once, unless no piece-free cut is found within a text.
PART_BYTES = 1 << 18
#: Where no piece reaches across: before a blank that follows something else, and before a line end.
_CUT = re.compile(rb"(?<=[^ ]) |\n")


@dataclass
class Pieces:
    """A model's pieces as bytes, with blanks for the mark that stands for them, and their weights.

    A piece's weight is (1 + rank) ** -theta, the rank being its merge order. A character without a
    piece of its own is spelled by its bytes' pieces.
    """

    by_bytes: dict[bytes, int]
    texts: list[bytes]
    weights: np.ndarray
    byte_ids: np.ndarray
    byte_weight: float
    longest: int

    @classmethod
    def load(cls, model_path: str, theta: float = 1.0) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        texts, by_bytes, byte_ids = [b""] * n, {}, np.full(256, -1, dtype=np.int32)
        weights = np.zeros(n)
        for i in range(n):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(name[1:-1], 16)] = i
                texts[i] = bytes([int(name[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                texts[i] = name.replace("▁", " ").encode()
                rank = max(0.0, -model.get_score(i))
                weights[i] = (1.0 + (rank if rank < 1e8 else 0.0)) ** -theta
                by_bytes[texts[i]] = i
        if (byte_ids < 0).any():
            raise ValueError("the model has no piece for some bytes")
        if any(b" " in t.lstrip(b" ") or b"\n" in t for t in by_bytes):
            raise ValueError("a piece reaches across a blank or a line end")
        return cls(by_bytes, texts, weights, byte_ids, float((1.0 + n) ** -theta), max(map(len, by_bytes)))


class Table:
    """The pieces as a tree of their bytes, for all places of a text at once."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        used = sorted({b for t in pieces.by_bytes for b in t})
        #: Of each byte, its column; bytes of no piece share one that leads nowhere.
        self.column = np.full(256, len(used), dtype=np.int32)
        self.column[used] = np.arange(len(used))
        self.width = len(used) + 1
        inner = {b"": 0}  # beginnings of longer pieces
        for t in pieces.by_bytes:
            for k in range(1, len(t)):
                inner.setdefault(t[:k], len(inner))
        self.piece = np.array([-1, *pieces.by_bytes.values()], dtype=np.int32)
        leaf = {t: k for k, t in enumerate(pieces.by_bytes, 1)}
        #: Of each beginning and byte: the beginning that follows or 0, and the place in ``piece`` of what it spells, or 0.
        self.onward = np.zeros(len(inner) * self.width, dtype=np.int32)
        self.spells = np.zeros(len(inner) * self.width, dtype=np.int32)
        for t, node in inner.items():
            if t:
                self.onward[inner[t[:-1]] * self.width + self.column[t[-1]]] = node
        for t, k in leaf.items():
            self.spells[inner[t[:-1]] * self.width + self.column[t[-1]]] = k
        weights = pieces.weights.copy()
        weights[pieces.byte_ids] = pieces.byte_weight
        self.weights = weights
        #: Segments of this many bytes or fewer can neither underflow nor, as ways double with a byte at most, overflow.
        least = max(1.0, -math.log2(weights[weights > 0].min()))
        self.safe = int(900 / least)
        #: Longer ones shift what gets smaller than this: two longest pieces in a row then still do not underflow.
        spread = 2 * least * pieces.longest
        self.number = float if spread < 1000 else np.longdouble
        self.low = self.number(2) ** -(1000 if self.number is float else 16000) * self.number(2) ** int(spread / 2)
        if spread > 16000:
            raise ValueError("theta is too large for these pieces")


def uniform(mixed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on a row's mixed seed and a place in its text alone."""
    x = mix(mixed + places.astype(np.uint64) * np.uint64(_STEP))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _edges(raw: np.ndarray, real: np.ndarray, table: Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ends, pieces) of all pieces in the bytes, the longest first; the ends of one entry are distinct."""
    columns = table.column[raw]
    lead = (raw & 0xC0) != 0x80
    begins = np.flatnonzero(lead)
    sizes = np.diff(np.append(begins, len(raw)))
    number = np.cumsum(lead) - 1  # of each byte, its character
    own = ~real[begins]  # characters that need no spelling
    at, node, found = np.flatnonzero(real).astype(np.int32), 0, []
    for length in range(1, table.pieces.longest + 1):
        slot = node * table.width + columns[at + (length - 1)]
        spelt = table.spells[slot]
        hit = np.flatnonzero(spelt)
        if len(hit):
            starts = at[hit]
            found.append((length, starts + length, table.piece[spelt[hit]]))
            if length <= 4:
                own[number[starts[lead[starts] & (sizes[number[starts]] == length)]]] = True
        node = table.onward[slot]
        on = np.flatnonzero(node)
        at, node = at[on], node[on]
        if not len(at):
            break
    bare = np.flatnonzero(~own[number])
    return [*found[::-1], (1, bare + 1, table.pieces.byte_ids[raw[bare]])]


def _one_by_one(js: list[int], first: list[int], source: list[int], weight: list, table: Table) -> tuple[list, list]:
    """Of one long segment, whose pieces end at ``js``: the weight of every edge with what is before it, and their sum at each end.

    What is compared lies no further apart than the longest piece, so that all weights share one scale;
    where they get too small or too large, those that are still needed are shifted. Powers of two do not round.
    """
    start, reach = min(source[first[0]:first[1]]), table.pieces.longest
    low, high, up, down = table.low, 1 / table.low, 1 / table.low, table.low
    total, parts, wholes = [0.0] * (js[-1] - start + 1), [], []
    total[0] = table.number(1)
    for k, j in enumerate(js):
        a, b = first[k], first[k + 1]
        own = [total[i - start] * w for i, w in zip(source[a:b], weight[a:b])]
        whole = sum(own)
        parts += own
        wholes.append(whole)
        j -= start
        total[j] = whole
        if not low < whole < high:
            shift = up if whole < 1 else down
            since = max(0, j - reach)
            total[since : j + 1] = [x * shift for x in total[since : j + 1]]
    return parts, wholes


def _draw(raw: np.ndarray, real: np.ndarray, mixed: np.ndarray, places: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Of each place, whether a piece of the drawn segmentation ends there, and which.

    ``mixed`` and ``places``: of each byte, its row's seed and the place in the text behind it.
    """
    n = len(raw)
    edges = _edges(raw, real, table)
    degree, over = np.zeros(n + 1, dtype=np.int32), np.zeros(n + 2, dtype=np.int32)
    for length, ends, _ in edges:
        degree[ends] += 1
        if length > 1:
            over[ends - length + 1] += 1
            over[ends] -= 1
    # Segments between places that no piece reaches across are drawn independently.
    cut = np.cumsum(over)[: n + 1] == 0
    starts = np.flatnonzero(cut[:-1])
    sizes = np.diff(np.append(starts, n))
    step = np.zeros(n + 1, dtype=np.int32)
    step[1:] = np.arange(1, n + 1) - np.repeat(starts, sizes)
    long = np.zeros(n + 1, dtype=bool)
    long[1:] = np.repeat(sizes > table.safe, sizes)
    step[long] = table.safe + 1
    held = np.flatnonzero(degree).astype(np.int32)
    held = held[np.argsort(step[held].astype(np.uint16 if table.safe < 65535 else np.int64), kind="stable")]
    first = np.concatenate(([0], np.cumsum(degree[held])))
    slot = np.zeros(n + 1, dtype=np.int32)
    slot[held] = first[:-1]
    source, piece = np.empty(first[-1], dtype=np.int32), np.empty(first[-1], dtype=np.int32)
    for length, ends, ids in edges:
        at = slot[ends]
        source[at], piece[at] = ends - length, ids
        slot[ends] = at + 1
    weight = table.weights[piece]
    total, chance = np.ones(n + 1), np.ones(first[-1])
    groups = np.searchsorted(step[held], np.arange(1, table.safe + 2)).tolist()
    for a, b in zip(groups, groups[1:], strict=False):
        if a == b:
            continue
        ea, eb = first[a], first[b]
        parts = total[source[ea:eb]] * weight[ea:eb]
        whole = np.add.reduceat(parts, first[a:b] - ea)
        chance[ea:eb] = parts / np.repeat(whole, degree[held[a:b]])
        total[held[a:b]] = np.where(cut[held[a:b]], 1.0, whole)
    if groups[-1] < len(held):
        rest = held[groups[-1] :]
        breaks = np.flatnonzero(np.diff(np.searchsorted(starts, rest, side="left")))
        froms, weights = source.tolist(), list(weight.astype(table.number)) if table.number is not float else weight.tolist()
        for part in np.split(np.arange(groups[-1], len(held)), breaks + 1):
            a, b = part[0], part[-1] + 1
            parts, wholes = _one_by_one(held[a:b].tolist(), first[a : b + 1].tolist(), froms, weights, table)
            chance[first[a] : first[b]] = np.array(parts) / np.repeat(np.array(wholes), degree[held[a:b]])
    pick = first[:-1].copy()
    left = np.flatnonzero(np.diff(first) > 1)
    aim = uniform(mixed[held[left] - 1], places[held[left] - 1]) - chance[pick[left]]
    k = 1
    while len(left):
        on = (aim >= 0) & (first[left] + k < first[left + 1])
        left, aim = left[on], aim[on]
        own = chance[first[left] + k]
        pick[left[own > 0]] = first[left[own > 0]] + k
        aim, k = aim - own, k + 1
    begin, which = np.zeros(n + 1, dtype=np.int32), np.zeros(n + 1, dtype=np.int32)
    begin[held], which[held] = source[pick], piece[pick]
    # From the end of every segment, from piece to piece.
    drawn = np.zeros(n + 1, dtype=bool)
    inside, short = real[starts], sizes <= table.safe
    at, floor = (starts + sizes)[inside & short], starts[inside & short]
    while len(at):
        drawn[at] = True
        at = begin[at]
        on = at > floor
        at, floor = at[on], floor[on]
    for a, size in zip(starts[inside & ~short].tolist(), sizes[inside & ~short].tolist(), strict=True):
        back, path, j = (begin[a : a + size + 1] - a).tolist(), [], size
        while j:
            path.append(j)
            j = back[j]
        drawn[a + np.array(path)] = True
    return drawn, which


def _spans(texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
    """Runs of (text, begin, end) of PART_BYTES or so; a longer text is cut where no piece reaches across."""
    run, size = [], 0
    for k, text in enumerate(texts):
        begin = 0
        while begin < len(text):
            end = len(text)
            if end - begin > PART_BYTES:
                found = _CUT.search(text, begin + PART_BYTES)
                end = found.start() if found else end
            if run and size + end - begin > PART_BYTES:
                yield run
                run, size = [], 0
            run.append((k, begin, end))
            size += end - begin
            begin = end
    if run:
        yield run


def sample(texts: list[bytes], seeds: np.ndarray, table: Table) -> list[np.ndarray]:
    """Piece ids of each text: one segmentation, drawn in proportion to the product of its pieces' weights.

    Every text gets a blank in front. A text's draw depends on its seed alone, not on
    the other texts. Forward filtering gives each place the chances of the pieces that end
    there; as a place's random number is its own, all places are drawn at once, and the backward pass
    follows the drawn pieces from the end.
    """
    full = [b" " + t if t else b"" for t in texts]
    mixed = mix(np.asarray(seeds, dtype=np.uint64))
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for run in _spans(full):
        wall = bytes([_WALL])
        raw = np.frombuffer(wall.join([full[k][a:b] for k, a, b in run]) + wall, dtype=np.uint8)
        owner, begins, ends = np.array(run, dtype=np.int64).T
        lengths = ends - begins + 1
        stops = np.cumsum(lengths)
        real = np.ones(len(raw), dtype=bool)
        real[stops - 1] = False
        places = np.arange(1, len(raw) + 1) - np.repeat(stops - lengths - begins, lengths)
        drawn, which = _draw(raw, real, np.repeat(mixed[owner], lengths), places, table)
        path = np.flatnonzero(drawn)
        for k, part in zip(owner.tolist(), np.split(which[path], np.searchsorted(path, stops[:-1] - 1, side="right")), strict=True):
            found[k].append(part)
    none = np.zeros(0, dtype=np.int32)
    return [np.concatenate(f) if len(f) > 1 else f[0] if f else none for f in found]


def join(ids: np.ndarray, pieces: Pieces) -> bytes:
    """The text of piece ids, without the blank in front."""
    return b"".join(map(pieces.texts.__getitem__, ids.tolist()))[1:]
