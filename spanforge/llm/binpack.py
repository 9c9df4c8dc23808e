"""Bin packing of a histogram of lengths by bin completion with branch and bound, best fit as incumbent.

Equal lengths are interchangeable, so a packing is a list of patterns, each with the
number of bins that follow it. Work depends on the number of different lengths (at
most the capacity), not on the number of pieces.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and by pieces of which no two fit together.

    For each threshold s: pieces over capacity - s stand alone; those over half take
    a bin each, and what is left of those bins takes pieces from s to half.
    """
    lengths = sorted(counts)
    count, volume = [0], [0]
    for n in lengths:
        count.append(count[-1] + counts[n])
        volume.append(volume[-1] + n * counts[n])
    best = -(-volume[-1] // capacity)
    half = bisect_right(lengths, capacity // 2)
    for k in range(half + 1):
        small = lengths[k] if k < half else capacity // 2 + 1
        alone = bisect_right(lengths, capacity - small)
        alone = max(alone, half)
        middle, room = count[alone] - count[half], capacity * (count[alone] - count[half]) - (volume[alone] - volume[half])
        rest = volume[half] - volume[min(k, half)]
        best = max(best, count[-1] - count[alone] + middle + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Counter:
    """Longest pieces first, each into the fullest bin that still takes it; equal steps are taken at once."""
    open_bins: dict[int, Counter] = {}  # room -> patterns

    def put(room: int, pattern: Pattern, times: int) -> None:
        open_bins.setdefault(room, Counter())[pattern] += times

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, ((length, each),), left // each)
                if left % each:
                    put(capacity - (left % each) * length, ((length, left % each),), 1)
                break
            pattern, times = next(iter(open_bins[room].items()))
            copies = room // length
            bins = min(times, left // copies)
            if not bins:
                copies, bins = left, 1
            open_bins[room][pattern] -= bins
            if not open_bins[room][pattern]:
                del open_bins[room][pattern]
                if not open_bins[room]:
                    del open_bins[room]
            put(room - copies * length, (*pattern, (length, copies)), bins)
            left -= copies * bins
    total: Counter = Counter()
    for patterns in open_bins.values():
        total.update(patterns)
    return total


class _View:
    """The lengths that are left, longest first, and which sums those from each place on can make.

    Shorter lengths soon make all sums that can be made; from there on places share one number, as a search keeps many views.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.lengths = sorted((n for n, c in counts.items() if c), reverse=True)
        self.minus = [-n for n in self.lengths]
        self.reach, sums, mask = [1] * (len(self.lengths) + 1), 1, (1 << capacity + 1) - 1
        for i in range(len(self.lengths) - 1, -1, -1):
            n, copies, step, shorter = self.lengths[i], min(counts[self.lengths[i]], capacity // self.lengths[i]), 1, sums
            while copies:
                step = min(step, copies)
                sums |= sums << n * step & mask
                copies -= step
                step *= 2
            if sums == shorter:
                sums = shorter
            self.reach[i] = sums


class _Spent(Exception):
    """The budget of steps is used up."""


class _Budget:
    def __init__(self, steps: int) -> None:
        self.left = steps

    def spend(self) -> None:
        self.left -= 1
        if self.left < 0:
            raise _Spent


def _exactly(view: _View, counts: dict[int, int], longest: int, total: int, budget: _Budget, start: int = 0, held: tuple = ()) -> Iterator[tuple]:
    """Every multiset of what is left beside one longest piece with this sum, as ((length, copies), ...); those with longer pieces come first."""
    if not total:
        yield held
        return
    lengths, reach = view.lengths, view.reach
    i = max(start, bisect_left(view.minus, -total))
    while i < len(lengths) and reach[i] >> total & 1:
        n = lengths[i]
        for k in range(min(total // n, counts[n] - (n == longest)), 0, -1):
            if reach[i + 1] >> total - k * n & 1:
                budget.spend()
                yield from _exactly(view, counts, longest, total - k * n, budget, i + 1, (*held, (n, k)))
        i += 1
        budget.spend()


def dominates(a: tuple, b: tuple) -> bool:
    """Whether b's pieces can be dealt out over a's so that none of a's pieces is shorter than what it gets.

    Then a bin filled like b can be filled like a: a's pieces change places with b's groups, wherever they are."""
    rooms = [n for n, k in a for _ in range(k)]
    pieces = [n for n, k in b for _ in range(k)]
    if sum(pieces) > sum(rooms) or len(pieces) > 12:  # longer lists aren't worth the search
        return False

    def deal(i: int) -> bool:
        if i == len(pieces):
            return True
        tried = set()
        for j, room in enumerate(rooms):
            if room >= pieces[i] and room not in tried:
                tried.add(room)
                rooms[j] -= pieces[i]
                if deal(i + 1):
                    return True
                rooms[j] += pieces[i]
        return False

    return deal(0)


def completions(counts: dict[int, int], longest: int, capacity: int, waste: int, view: _View | None = None, budget: _Budget | None = None) -> Iterator[Pattern]:
    """Undominated fillings of a bin around the longest piece that waste no more than `waste`, least waste first.

    counts: what is left, the longest piece among it. A dominated filling has no larger sum and, of equal sums, comes
    later; so each is held against those before it, and one into which another piece would still fit is left out too.
    """
    view, budget = view or _View(counts, capacity), budget or _Budget(1 << 62)
    room, before = capacity - longest, []
    for total in range(room, max(-1, room - waste - 1), -1):
        if view.reach[0] >> total & 1:
            for filling in _exactly(view, counts, longest, total, budget):
                if not any(dominates(x, filling) for x in before):
                    if len(before) < 64:
                        before.append(filling)
                    yield _joined(longest, filling)


def _joined(longest: int, filling: tuple) -> Pattern:
    c = Counter({longest: 1})
    for n, k in filling:
        c[n] += k
    return tuple(sorted(c.items(), reverse=True))


def branch_and_bound(counts: dict[int, int], capacity: int, best: Counter, steps: int = 2_000_000) -> tuple[Counter, bool]:
    """The packing that bin completion finds, with no more bins than `best`, the incumbent; and whether no better one exists.

    At a node the longest piece left is completed by each undominated filling in turn, at first in as many bins as the
    pieces last, then in fewer. A branch ends where its waste exceeds what a packing with few enough bins can waste: for the first
    packing the incumbent's bins, then one less than the last found. The search ends when the lower bound is reached,
    all branches are tried, or `steps` are used up; then what was found last, or else the incumbent, is returned.
    """
    counts, budget = {n: c for n, c in counts.items() if c}, _Budget(steps)
    total, goal = sum(n * c for n, c in counts.items()), lower_bound(counts, capacity)
    found, most = None, sum(best.values())  # bins that a packing may have
    pieces = sum(counts.values())

    def choices(view: _View, longest: int, waste: int) -> Iterator[tuple[Pattern, int]]:
        for pattern in completions(counts, longest, capacity, most * capacity - total - waste, view, budget):
            for times in range(min(counts[n] // k for n, k in pattern), 0, -1):
                yield pattern, times

    def take(pattern: Pattern, times: int) -> int:
        for n, k in pattern:
            counts[n] -= k * times
        return sum(k for _, k in pattern) * times

    if not pieces:
        return Counter(), True
    view = _View(counts, capacity)
    stack = [[None, None, view, 0, pieces, 0]]  # choices, the one taken, view, waste before, pieces left before, spent lengths
    bins = 0
    try:
        while stack:
            node = stack[-1]
            if node[1]:
                pattern, times = node[1]
                take(pattern, -times)
                bins -= times
                node[1] = None
            if node[0] is None:
                longest = next(n for n in node[2].lengths if counts[n])
                node[0] = choices(node[2], longest, node[3])
            chosen = next(node[0], None)
            if chosen is None:
                stack.pop()
                continue
            budget.spend()
            pattern, times = chosen
            waste = node[3] + times * (capacity - sum(n * k for n, k in pattern))
            if waste > most * capacity - total:
                continue
            left = node[4] - take(pattern, times)
            bins += times
            node[1] = chosen
            if left:
                spent = node[5] + sum(not counts[n] for n, _ in pattern)
                fresh = spent >= max(8, len(node[2].lengths) // 64)
                stack.append([None, None, _View(counts, capacity) if fresh else node[2], waste, left, 0 if fresh else spent])
                continue
            found = Counter()
            for x in stack:
                found[x[1][0]] += x[1][1]
            most = bins - 1
            if bins <= goal:
                return found, True
        return found if found is not None else best, True
    except _Spent:
        return found if found is not None else best, False


def _of_bins(patterns: Counter) -> dict[int, int]:
    out: Counter = Counter()
    for pattern, times in patterns.items():
        for n, k in pattern:
            out[n] += k * times
    return dict(out)


def pack(counts: dict[int, int], capacity: int, rounds: int = 60, pieces: int = 90, seed: int = 1) -> Counter:
    """Patterns with their numbers of bins. Lengths are from 1 to the capacity.

    Best fit decreasing is the incumbent, bin completion over the whole histogram builds the packing. Where that stops
    above the lower bound without having tried all branches, bins are emptied and completed anew, `rounds` times: the
    least full ones, in which the waste lies, and others by chance, of about `pieces` pieces together.
    """
    counts = {n: c for n, c in counts.items() if c}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a length is out of range")
    goal, rng = lower_bound(counts, capacity), random.Random(seed)
    best, settled = branch_and_bound(counts, capacity, best_fit_decreasing(counts, capacity))
    for _ in range(rounds):
        if settled or sum(best.values()) <= goal:
            break
        order = sorted(best, key=lambda p: (sum(n * k for n, k in p) - capacity * (rng.random() < 0.3), rng.random()))
        loose, held = Counter(), 0
        for pattern in order:
            each = sum(k for _, k in pattern)
            take = min(best[pattern], max(0, (pieces - held) // each))
            if take:
                loose[pattern] += take
                held += take * each
        part = _of_bins(loose)
        again, _ = branch_and_bound(part, capacity, loose, 60_000)
        best = +(best - loose + again)
    return best
