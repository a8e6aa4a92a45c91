"""Edit counts of text pairs, by word and by character.

Spark's ``levenshtein`` gives a distance only, and it fills the whole table cell by cell. Scoring
also needs substitutions, deletions, insertions and hits, so this is one Arrow UDF per unit. It
runs the bit-vector recurrence of Myers (1999), in the banded form of Hyyrö (2003), on Python
integers: one step per hypothesis unit, whatever the length of the reference, and only as many
diagonals as the pair has edits. Bands of many pairs lie side by side in one integer, so a step of
all of them costs little more than one of one pair; numpy compares the units of all steps at once.

The walk back along an alignment looks only at the places where it leaves its diagonal. Costs of
substitutions and hits on it follow from the total cost.

Most pairs need no band. Units that one side holds more often than the other are a lower bound of the
edits, whatever their order. A walk along both sides that steps over short differences is an upper one;
where both agree, the cost is proved, and so are its parts: with as many edits as units that the
reference has too many of, say, nothing is inserted. All other pairs go to the bands.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COST = ["errors", "units"]
COUNTS = ["subs", "dels", "ins", "hits", *COST]
#: Diagonals beside the straight way that a band starts with, at most.
_FIRST_MARGIN = 64
#: Bits of an integer of bands, most bands in it, and least length of the shortest pair beside the longest.
_WIDEST = 1 << 15
_MOST_LANES = 512
_ALIKE = 0.5
#: Bytes of the comparisons made at once, and of the columns kept for the walk back.
_COMPARED = 1 << 22
_KEPT = 1 << 26
#: Most tokens of a difference that the walk steps over, and equal ones looked for behind it, the more the better.
_STEP = 8
_BEHIND = (3, 2, 1)
#: Most tokens in a row that the walk leaves out on one side.
_FAR = 512
#: Units of the longest difference whose edits the walk counts.
_SMALL = 256
#: Characters of both sides that a task splits and scores at once.
_SCORED = 1 << 22
#: The differences of up to ``_STEP`` tokens, cheapest first.
_STEPS = [(e, e - k) if turn else (e - k, e) for e in range(1, _STEP + 1) for k in range(e + 1) for turn in (0, 1)]


def _trim(ref: Sequence, hyp: Sequence) -> tuple[Sequence, Sequence, int]:
    """Both sides without their common head and tail, and how many units those hold."""
    head, shorter = 0, min(len(ref), len(hyp))
    while head < shorter and ref[head] == hyp[head]:
        head += 1
    tail = 0
    while tail < shorter - head and ref[-1 - tail] == hyp[-1 - tail]:
        tail += 1
    return ref[head : len(ref) - tail], hyp[head : len(hyp) - tail], head + tail


def _codes(ref: Sequence, hyp: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 1 that are equal where the units are."""
    if isinstance(ref, str):
        coded = [np.frombuffer(side.encode("utf-32-le"), np.uint32) for side in (ref, hyp)]
        used = np.zeros(int(max(c.max() for c in coded)) + 1, np.uint32)
        used[coded[0]] = used[coded[1]] = 1
        number = np.cumsum(used, dtype=np.uint32)
        coded, most = [number[c] for c in coded], int(number[-1])
    else:
        known: dict = {}
        number = known.setdefault
        coded = [np.array([number(unit, len(known) + 1) for unit in side]) for side in (ref, hyp)]
        most = len(known)
    kind = np.min_scalar_type(most)
    return coded[0].astype(kind), coded[1].astype(kind)


def _small_cost(ref: Sequence, hyp: Sequence) -> int | None:
    """Edits between two short sequences, by bit vectors; None where they are long."""
    if not ref or not hyp or len(ref) == len(hyp) == 1:
        return max(len(ref), len(hyp))
    if len(ref) == len(hyp) and sum(map(ne, ref, hyp)) <= 1:
        return int(ref != hyp)
    if max(len(ref), len(hyp)) > _SMALL:
        return None
    places: dict = {}
    for i, unit in enumerate(ref):
        places[unit] = places.get(unit, 0) | 1 << i
    full, top = (1 << len(ref)) - 1, 1 << len(ref) - 1
    rise, fall, cost = full, 0, len(ref)
    for unit in hyp:
        same = places.get(unit, 0)
        flat = ((((same & rise) + rise) ^ rise) | same | fall) & full
        up, down = fall | full ^ (flat | rise), flat & rise
        cost += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        rise, fall = down | full ^ (flat | up), flat & up
    return cost


def _far(one: Sequence, two: Sequence, p: int, q: int, behind: int) -> int:
    """How many tokens of the first side to leave out so that the sides agree again, 0 if too many."""
    at, end = p + _STEP, min(p + _FAR, len(one))
    while at < end:
        try:
            at = one.index(two[q], at + 1, end)
        except ValueError:
            return 0
        if one[at : at + behind] == two[q : q + behind]:
            return at - p
    return 0


def _next_step(a: Sequence, b: Sequence, i: int, j: int) -> tuple[int, int]:
    """The shortest difference at two places behind which the sides agree again, else all that is left."""
    m, n = len(a), len(b)
    for behind in _BEHIND:
        for x, y in _STEPS:
            p, q = i + x, j + y
            if p < m and q < n:
                if a[p] == b[q] and (behind == 1 or a[p : p + behind] == b[q : q + behind]):
                    return x, y
            elif p == m and q == n:
                return x, y
        if behind == _BEHIND[0] and i < m and j < n:
            for one, two, p, q in ((a, b, i, j), (b, a, j, i)):
                far = _far(one, two, p, q, behind)
                if far:
                    return (far, 0) if one is a else (0, far)
    return m - i, n - j


def _walked(ref: Sequence, hyp: Sequence) -> tuple[int | None, bool]:
    """Edits along a walk over a pair, None where it finds no way, and whether the units themselves ask for as many."""
    chars = isinstance(ref, str)
    # the same unit behind both sides changes no cost; each word of a text takes the space behind it along
    a, b = ([w + " " for w in side.split(" ")] for side in (ref, hyp)) if chars else (ref, hyp)
    i, j, m, n, cost = 0, 0, len(a), len(b), 0
    only_ref, only_hyp = [], []
    if m == n and (moved := sum(map(ne, a, b))) * 4 > m:
        # every few words differ, so at best they do so in place
        only_ref, only_hyp = ([w for w, differs in zip(side, map(ne, a, b)) if differs] for side in (a, b))
        i, j, cost = m, n, moved
        if chars:
            return None, False
    while i < m or j < n:
        while i < m and j < n and a[i] == b[j]:
            i, j = i + 1, j + 1
        x, y = _next_step(a, b, i, j)
        one, two = a[i : i + x], b[j : j + y]
        i, j = i + x, j + y
        only_ref += one
        only_hyp += two
        added = _small_cost("".join(one), "".join(two)) if chars else _small_cost(one, two)
        if added is None:
            return None, False
        cost += added
    # what the walk found equal counts as much on either side
    if chars:
        only_ref, only_hyp = "".join(only_ref), "".join(only_hyp)
    more = (Counter(only_ref) - Counter(only_hyp)).total()
    return cost, cost == max(more, more + len(hyp) - len(ref))


class _Bands:
    """Bands of pairs side by side in one integer, each in a lane of ``bits`` bits.

    A band holds the diagonals ``low .. low + bits - 2`` (row minus column) of the edit table. A
    column is a pair of bit vectors, the rows where the cost rises and falls by one against the row
    above. Bit 0 of a lane after column ``j`` belongs to row ``j + 1 + low``; its top bit stays 0, so
    that no carry reaches the next lane.
    """

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]], bits: int) -> None:
        self.bits, self.lanes = bits, len(pairs)
        self.bytes = bits // 8
        self.rows, self.cols = [len(r) for r, _ in pairs], [len(h) for _, h in pairs]
        self.longest = max(self.cols)
        skew = [r - c for r, c in zip(self.rows, self.cols)]
        self.margin = [(bits - 4 - abs(s)) // 2 for s in skew]
        self.low = [min(0, s) - m - 1 for s, m in zip(skew, self.margin)]
        self.corner = [s - low for s, low in zip(skew, self.low)]
        one = (1 << bits - 1) - 1
        self.full = sum(one << bits * lane for lane in range(self.lanes))
        self.first = (sum((one >> -low << -low) << bits * lane for lane, low in enumerate(self.low)), 0)
        # row x + low of the reference is at place x, so column c meets the places c .. c + bits - 1
        kind = max((r.dtype for r, _ in pairs), key=lambda k: k.itemsize)
        self.ref = np.zeros((self.lanes, self.longest + bits), kind)
        self.hyp = np.zeros((self.lanes, self.longest), kind)
        for lane, (r, h) in enumerate(pairs):
            end = min(len(r), self.longest + bits + self.low[lane])
            self.ref[lane, -self.low[lane] : end - self.low[lane]] = r[:end]
            # no unit of a reference is 0, and past the last column nothing counts
            self.hyp[lane, : len(h)] = h

    def _same(self, start: int, stop: int) -> Iterator[int]:
        """For each column, the bits of the places whose unit is the column's."""
        stride = max(1, _COMPARED // (self.lanes * self.bits))
        for a in range(start, stop, stride):
            b = min(a + stride, stop)
            seen = np.lib.stride_tricks.sliding_window_view(self.ref[:, a : b + self.bits - 1], self.bits, axis=1)
            equal = np.packbits(seen == self.hyp[:, a:b, None], axis=2, bitorder="little")
            data = np.ascontiguousarray(equal.transpose(1, 0, 2)).tobytes()
            size = self.lanes * self.bytes
            for at in range(0, len(data), size):
                yield int.from_bytes(data[at : at + size], "little")

    def run(self, start: int, stop: int, column: tuple[int, int], keep: bool) -> tuple[tuple[int, int], list, list, list]:
        """The column after ``stop``; counters of the columns in which the corner's diagonal rose, a
        binary digit of all lanes in each; and with ``keep`` the cells that an alignment leaves upwards
        or to the left, and those that it leaves upwards."""
        full, size = self.full, self.lanes * self.bytes
        corners = sum(1 << self.bits * lane + c for lane, c in enumerate(self.corner) if self.cols[lane] > start)
        ends = sorted({c for c in self.cols if start < c < stop})
        end = ends[0] if ends else stop
        rise, fall = column
        digits, leaves, ups = [], [], []
        for j, same in enumerate(self._same(start, stop), start):
            if j == end:
                corners = sum(1 << self.bits * lane + c for lane, c in enumerate(self.corner) if self.cols[lane] > j)
                end = next((e for e in ends if e > j), stop)
            same &= full
            before = fall
            flat = ((((same & rise) + rise) ^ rise) | same | fall) & full
            rose, digit = flat & corners ^ corners, 0
            while rose:
                if digit == len(digits):
                    digits.append(0)
                was = digits[digit]
                digits[digit], rose, digit = was ^ rose, was & rose, digit + 1
            right_up = fall | (full ^ (flat | rise))
            right_down = flat & rise
            flat = flat >> 1 & full
            rise = right_down | (full ^ (flat | right_up))
            fall = flat & right_up
            if keep:
                leaves.append((rise | before >> 1 & full).to_bytes(size, "little"))
                ups.append(rise.to_bytes(size, "little"))
        return (rise, fall), digits, leaves, ups

    def _read(self, digits: list[int]) -> list[int]:
        """The counter of each lane."""
        spots = [self.bits * lane + corner for lane, corner in enumerate(self.corner)]
        return [sum((digit >> spot & 1) << k for k, digit in enumerate(digits)) for spot in spots]

    def solve(self, keep: bool) -> list[tuple[int, int, int] | None]:
        """Cost, deletions and insertions of each lane (0 without ``keep``); None if its band is too
        narrow to prove the cost, which ``self.cost`` then bounds from above.

        An alignment that leaves the band has at least two more edits than |skew| + 2 margin, so a cost
        up to one more is exact and all shortest alignments are inside.
        """
        stride = max(64, _KEPT // (2 * self.lanes * self.bytes))
        column, saved = self.first, []
        self.cost = np.maximum(np.subtract(self.rows, self.cols), 0)
        single = keep and self.longest <= stride
        for start in range(0, self.longest, stride):
            saved.append(column)
            column, digits, *kept = self.run(start, min(start + stride, self.longest), column, single)
            self.cost += self._read(digits)
        room = [abs(r - c) + 2 * m + 1 for r, c, m in zip(self.rows, self.cols, self.margin)]
        proved = [int(c) <= most for c, most in zip(self.cost, room)]
        walks = [_Walk(self, lane) if keep and ok else None for lane, ok in enumerate(proved)]
        for start in reversed(range(0, self.longest, stride) if keep and any(proved) else ()):
            if not single:
                _, _, *kept = self.run(start, min(start + stride, self.longest), saved[start // stride], True)
            # a first row that stops every walk
            leaves, ups = b"".join([b"\xff" * (self.lanes * self.bytes), *kept[0]]), b"".join([b"\0", *kept[1]])
            for walk in walks:
                if walk is not None:
                    walk.back(leaves, ups, start)
        found = [(w.i + w.dels, w.j + w.ins) if w is not None else (0, 0) for w in walks]
        return [(int(c), *f) if ok else None for c, f, ok in zip(self.cost, found, proved)]


class _Walk:
    """The walk back through one lane: a deletion first, then an insertion where the cell to the left
    is smaller than the diagonal one, else the diagonal."""

    def __init__(self, bands: _Bands, lane: int) -> None:
        self.i, self.j, self.dels, self.ins = bands.rows[lane], bands.cols[lane], 0, 0
        self.low, self.lane, self.bytes, self.size = bands.low[lane], lane, bands.bytes, bands.bytes * bands.lanes

    def back(self, leaves: bytes, ups: bytes, start: int) -> None:
        """Walk to column ``start``. Row 0 of ``leaves`` is that column's and has all bits set; the row
        of ``ups`` for it is one byte long."""
        i, j, size, base = self.i, self.j, self.size, self.lane * self.bytes
        while i and j > start:
            bit = i - j - 1 - self.low
            mask, byte = 1 << (bit & 7), base + (bit >> 3)
            at = (j - start) * size + byte
            end = at - min(i, j - start) * size
            while at > end and not leaves[at] & mask:
                at -= size
            steps = j - start - (at - byte) // size
            i, j = i - steps, j - steps
            if not i or j <= start:
                break
            if ups[at - size + 1] & mask:
                self.dels += 1
                i -= 1
            else:
                self.ins += 1
                j -= 1
        self.i, self.j = i, j


def _batches(pairs: dict[int, tuple[np.ndarray, np.ndarray]], margins: dict[int, int]) -> Iterator[tuple[int, list[int]]]:
    """Pairs that are about as long, with the width of their lanes. A lane that ends early, or is wider
    than it need be, costs less than the steps of a batch of its own."""
    bits = {at: -(-(abs(len(pairs[at][0]) - len(pairs[at][1])) + 2 * m + 4) // 8) * 8 for at, m in margins.items()}
    batch: list[int] = []
    widest = 0
    for at in sorted(margins, key=lambda at: (len(pairs[at][1]), bits[at]), reverse=True):
        wide = max(widest, bits[at])
        longest = len(pairs[batch[0]][1]) if batch else 0
        room = min(_WIDEST, 4 * _KEPT // max(longest, 1))  # so that all columns can be kept at once
        full = (len(batch) + 1) * wide > room or len(batch) >= _MOST_LANES
        if batch and (full or len(pairs[at][1]) < _ALIKE * longest):
            yield widest, batch
            batch, wide = [], bits[at]
        widest = wide
        batch.append(at)
    if batch:
        yield widest, batch


def _solve(refs: list[Sequence], hyps: list[Sequence], keep: bool) -> list[tuple[int, int, int, int]]:
    """Cost, deletions, insertions and units in common head and tail of every pair."""
    found: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)] * len(refs)
    pairs, margins, same = {}, {}, {}
    for at, (ref, hyp) in enumerate(zip(refs, hyps)):
        cost, proved = _walked(ref, hyp)
        if proved:
            found[at] = (cost, max(0, len(ref) - len(hyp)), max(0, len(hyp) - len(ref)), 0)
            continue
        ref, hyp, same[at] = _trim(ref, hyp)
        if ref and hyp:
            pairs[at] = _codes(ref, hyp)
            margins[at] = min(_FIRST_MARGIN, 4 + min(len(ref), len(hyp)) // 4)
            if cost is not None:  # a band that proves it
                margins[at] = min(margins[at], max(1, (cost - abs(len(ref) - len(hyp)) + 1) // 2))
        else:
            found[at] = (len(ref) + len(hyp), len(ref), len(hyp), same[at])
    while margins:
        wider = {}
        for bits, batch in _batches(pairs, margins):
            bands = _Bands([pairs[at] for at in batch], bits)
            for lane, (at, result) in enumerate(zip(batch, bands.solve(keep))):
                if result is not None:
                    found[at] = (*result, same[at])
                else:
                    skew = abs(bands.rows[lane] - bands.cols[lane])
                    wider[at] = min(4 * bands.margin[lane], (int(bands.cost[lane]) - skew + 1) // 2)
        margins = wider
    return found


def edit_costs(refs: list[Sequence], hyps: list[Sequence]) -> list[int]:
    """Edits of a shortest alignment for every pair."""
    return [cost for cost, *_ in _solve(refs, hyps, keep=False)]


def all_edits(refs: list[Sequence], hyps: list[Sequence]) -> list[tuple[int, int, int, int]]:
    """Substitutions, deletions, insertions and hits of one shortest alignment for every pair.

    Among equally short alignments the walk back takes a deletion first, then an insertion when the
    cell to the left is smaller than the diagonal one, else the diagonal.
    """
    out = []
    for ref, (cost, dels, ins, _) in zip(refs, _solve(refs, hyps, keep=True)):
        subs = cost - dels - ins
        out.append((subs, dels, ins, len(ref) - dels - subs))
    return out


def edit_cost(ref: Sequence, hyp: Sequence) -> int:
    """Edits of a shortest alignment of one pair."""
    return edit_costs([ref], [hyp])[0]


def count_edits(ref: Sequence, hyp: Sequence) -> tuple[int, int, int, int]:
    """The counts of ``all_edits`` for one pair."""
    return all_edits([ref], [hyp])[0]


def _struct(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.LongType()) for name in names])


def _counts(refs: list[Sequence], hyps: list[Sequence]) -> list[tuple[int, ...]]:
    rows = all_edits(refs, hyps)
    return [(*row, sum(row[:3]), row[0] + row[1] + row[3]) for row in rows]


def _costs(refs: list[Sequence], hyps: list[Sequence]) -> list[tuple[int, ...]]:
    return list(zip(edit_costs(refs, hyps), map(len, refs)))


def _slices(refs: pa.Array, hyps: pa.Array) -> Iterator[tuple[list[str], list[str]]]:
    """Texts of a batch, so many at a time that what is made of them stays small."""
    sizes = [pc.fill_null(pc.binary_length(side), 0).to_numpy(zero_copy_only=False) for side in (refs, hyps)]
    part = np.cumsum(sizes[0].astype(np.int64) + sizes[1]) // _SCORED
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(refs)]
    for start, stop in zip(edges, edges[1:]):
        yield refs.slice(start, stop - start).to_pylist(), hyps.slice(start, stop - start).to_pylist()


def _udf(score, split, names: list[str]):
    @F.arrow_udf(_struct(names))
    def scored(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        rows: list[tuple[int, ...]] = []
        for refs, hyps in _slices(ref, hyp):
            rows += score([split(r) for r in refs], [split(h) for h in hyps])
        made = np.array(rows, np.int64).reshape(-1, len(names))
        return pa.StructArray.from_arrays([pa.array(made[:, k]) for k in range(len(names))], names)

    return scored


_UDFS = {
    ("word", True): _udf(_counts, str.split, COUNTS),
    ("word", False): _udf(_costs, str.split, COST),
    ("char", True): _udf(_counts, str, COUNTS),
    ("char", False): _udf(_costs, str, COST),
}


def edits(ref: Column, hyp: Column, unit: str, parts: bool = True) -> Column:
    """Edits between texts already normalised, by word or by character; spaces are characters.

    The struct holds ``errors`` and ``units`` (of the reference), and with ``parts`` also ``subs``,
    ``dels``, ``ins`` and ``hits``.
    """
    return _UDFS[unit, parts](ref, hyp)
