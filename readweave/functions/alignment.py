"""Affine-gap alignment in numpy, vectorised over reads; regions and differences from its path."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

MATCH, SUB, INS, DEL = "M", "S", "I", "D"
_LOW = -(10**7)


@dataclass(frozen=True)
class Scorer:
    """Scores of the alignment of reads to the template; an N on either side scores ``n_match``."""

    match: int = 6
    n_match: int = -2
    mismatch: int = -3
    gap_open: int = -10
    gap_extend: int = -4

    def table(self) -> np.ndarray:
        out = np.full((256, 256), self.mismatch, np.int32)
        np.fill_diagonal(out, self.match)
        out[ord("N"), :] = self.n_match
        out[:, ord("N")] = self.n_match
        return out


def _fill(x: np.ndarray, y: np.ndarray, table: np.ndarray, gap_open: int, gap_extend: int, free_ends: bool):
    """Best scores of all prefixes: any end, ending in an insertion, ending in a deletion.

    ``x`` holds one read per row (padded ends change nothing before them), ``y`` is the
    template. A gap of k bases costs gap_open + k * gap_extend. With ``free_ends`` unaligned template ends are free.
    """
    n, width = x.shape
    m = len(y)
    # short reads fit into half the memory: no score leaves 16 bits
    reach = (width + m + 2) * (int(np.abs(table).max()) + abs(gap_open) + abs(gap_extend))
    kind, low = (np.int16, -15000) if reach < 15000 else (np.int32, _LOW)
    best = np.full((width + 1, m + 1, n), low, kind)
    ins, dele = best.copy(), best.copy()
    first, steps = kind(gap_open + gap_extend), (gap_extend * np.arange(m + 1)).astype(kind)[:, None]
    gap_open, gap_extend, letters = kind(gap_open), kind(gap_extend), table[:, y].T.astype(kind)
    best[0] = 0
    if not free_ends:
        dele[0, 1:] = gap_open + steps[1:]
        best[0, 1:] = dele[0, 1:]
    for i in range(1, width + 1):
        np.maximum(best[i - 1] + first, ins[i - 1] + gap_extend, out=ins[i])
        row = ins[i].copy()
        np.maximum(row[1:], best[i - 1, :-1] + letters.take(x[:, i - 1], axis=1), out=row[1:])
        # the best deletion up to each place opens at the best earlier one: a running maximum
        dele[i, 1:] = np.maximum.accumulate(row - steps, axis=0)[:-1] + (first + steps[:-1])
        np.maximum(row, dele[i], out=best[i])
    return best, ins, dele


def _trace(x: bytes, y: bytes, best, ins, dele, table, gap_open: int, gap_extend: int, j: int, free_ends: bool) -> list[tuple[int, int, str]]:
    """Path of (x, y, operation), 1-based after each step. From the end, diagonal steps come before insertions before deletions."""
    i, state, path = len(x), MATCH, []
    first = gap_open + gap_extend
    while i > 0 or (j > 0 and not free_ends):
        if state == MATCH:
            if i > 0 and j > 0 and best[i, j] == best[i - 1, j - 1] + table[x[i - 1], y[j - 1]]:
                path.append((i, j, MATCH if x[i - 1] == y[j - 1] else SUB))
                i, j = i - 1, j - 1
            elif i > 0 and best[i, j] == ins[i, j]:
                state = INS
            else:
                state = DEL
        elif state == INS:
            path.append((i, j, INS))
            if ins[i, j] != ins[i - 1, j] + gap_extend:
                state = MATCH
            i -= 1
        else:
            path.append((i, j, DEL))
            if dele[i, j] != dele[i, j - 1] + gap_extend:
                state = MATCH
            j -= 1
    path.reverse()
    return path


def _trace_block(x: np.ndarray, lens: np.ndarray, ends: np.ndarray, y: np.ndarray, best, ins, dele, table, gap_open: int, gap_extend: int):
    """Paths of a block of reads at once, every read one step back per round, each ending in the last column.

    Returns x, y and operation codes (0 match, 1 substitution, 2 insertion, 3 deletion) and the
    number of steps; unused columns on the left hold x = 0, y = -1.
    """
    n, most = len(lens), int((lens + ends).max(initial=0))
    px, py, po = np.zeros((n, most), np.int32), np.full((n, most), -1, np.int32), np.zeros((n, most), np.int8)
    i, j, state = lens.copy(), ends.copy(), np.zeros(n, np.int8)
    rows, at = np.flatnonzero(i > 0), most - 1
    while len(rows):
        a, b, s = i[rows], j[rows], state[rows]
        own = best[a, b, rows]
        letter, place = x[rows, a - 1], y[np.maximum(b, 1) - 1]
        diagonal = (s == 0) & (b > 0) & (own == best[a - 1, np.maximum(b, 1) - 1, rows] + table[letter, place])
        s = np.where((s == 0) & ~diagonal, np.where(own == ins[a, b, rows], 2, 3), s).astype(np.int8)
        px[rows, at], py[rows, at] = a, b
        po[rows, at] = np.where(diagonal, letter != place, s)
        insertion, deletion = s == 2, s == 3
        opened = np.zeros(len(rows), bool)
        k = np.flatnonzero(insertion)
        opened[k] = ins[a[k], b[k], rows[k]] != ins[a[k] - 1, b[k], rows[k]] + gap_extend
        k = np.flatnonzero(deletion)
        opened[k] = dele[a[k], b[k], rows[k]] != dele[a[k], b[k] - 1, rows[k]] + gap_extend
        state[rows] = np.where(opened | diagonal, 0, s)
        i[rows], j[rows] = a - (diagonal | insertion), b - (diagonal | deletion)
        rows, at = rows[i[rows] > 0], at - 1
    return px, py, po, (py >= 0).sum(1)


def _blocks(reads: Sequence[str], template: str, scorer: Scorer, block: int):
    """Places of reads in blocks of like length, with the best scores and the paths of each block."""
    table = scorer.table()
    y = np.frombuffer(template.encode(), np.uint8)
    raw = [r.encode("latin-1", "replace") for r in reads]
    order = sorted((i for i, r in enumerate(raw) if r), key=lambda i: len(raw[i]))
    start = 0
    while start < len(order):
        longest = len(raw[order[min(start + block, len(order)) - 1]])
        size = max(1, min(block, (1 << 23) // ((longest + 1) * (len(y) + 1))))
        some = order[start : start + size]
        start += size
        lens = np.array([len(raw[i]) for i in some])
        width = int(lens[-1])
        x = np.array([raw[i] for i in some], dtype=f"S{width}").view(np.uint8).reshape(len(some), width)
        best, ins, dele = _fill(x, y, table, scorer.gap_open, scorer.gap_extend, True)
        rows = np.arange(len(some))
        last = best[lens, :, rows]
        ends = last.argmax(1)
        yield np.array(some), last[rows, ends], _trace_block(x, lens, ends, y, best, ins, dele, table, scorer.gap_open, scorer.gap_extend)


def semiglobal(reads: Sequence[str], template: str, scorer: Scorer, block: int = 512) -> list[tuple[int, list[tuple[int, int, str]]]]:
    """Score and path of each read, aligned whole against any part of the template."""
    out: list = [(0, [])] * len(reads)
    for some, scores, (px, py, po, steps) in _blocks(reads, template, scorer, block):
        for k, i in enumerate(some):
            first = px.shape[1] - steps[k]
            ops = [(MATCH, SUB, INS, DEL)[o] for o in po[k, first:]]
            out[i] = (int(scores[k]), list(zip(px[k, first:].tolist(), py[k, first:].tolist(), ops)))
    return out


KINDS = ("complete", "partial_5", "partial_3")


def aligned_regions(reads: Sequence[str], template: str, scorer: Scorer, regions: Sequence[tuple[int, int]], block: int = 512):
    """Scores, and of every read and region the start, the end and the kind (an index of KINDS, -1 if absent).

    ``regions`` are template places (1-based start, exclusive end), in order. Template places
    never fall along a path, so a region starts at the first step at or behind its start (behind
    the last base read if its own first base was deleted) and ends at the first step at or behind
    its end. A read that begins inside a region shows its 3' part; the region in which the read's
    last step lies ends there without that base, is complete if the template is as far as a whole
    region would be, and is the last one seen. Regions without a base are absent.
    """
    scores = np.zeros(len(reads), np.int32)
    starts, stops, kinds = np.zeros((len(reads), len(regions)), np.int32), np.zeros((len(reads), len(regions)), np.int32), np.full((len(reads), len(regions)), -1, np.int8)
    for some, best, (px, py, po, steps) in _blocks(reads, template, scorer, block):
        scores[some] = best
        rows, last = np.arange(len(some)), px.shape[1] - 1
        opening = last + 1 - steps
        going = steps > 0
        for k, (start, end) in enumerate(regions):
            met = going & (py[rows, np.minimum(opening, last)] <= end)
            enter, leave = (py < start).sum(1), (py < end).sum(1)
            going &= ~met | (enter <= last)
            met &= going
            at = np.minimum(enter, last)
            x, y = px[rows, at], py[rows, at]
            first = np.where((po[rows, at] == 3) & (y == start), x + 1, x)
            inner = leave < last
            stop = np.where(inner, px[rows, np.minimum(leave, last)], px[:, last])
            whole = py[:, last] - first == end - start
            kind = np.where(inner, np.where((enter == opening) & (y > start), 1, 0), np.where(whole, 0, 2))
            found = met & (first < stop)
            starts[some[found], k], stops[some[found], k], kinds[some[found], k] = first[found], stop[found], kind[found]
            going &= ~met | inner
    return scores, starts, stops, kinds


def regions_of_path(path: list[tuple[int, int, str]], regions: Sequence[tuple[int, int]]) -> list[tuple[int, int, str] | None]:
    """What :func:`aligned_regions` tells of a read, from its path alone: for single reads and as its plain statement."""
    out: list[tuple[int, int, str] | None] = [None] * len(regions)
    if not path:
        return out
    places = [y for _, y, _ in path]
    last = len(path) - 1
    for k, (start, end) in enumerate(regions):
        if end < places[0]:
            continue
        enter = bisect_left(places, start)
        if enter > last:
            break
        x, y, op = path[enter]
        first = x + 1 if op == DEL and y == start else x
        leave = bisect_left(places, end)
        if leave < last:
            stop, kind = path[leave][0], "partial_5" if enter == 0 and y > start else "complete"
        else:
            stop, kind = path[last][0], "complete" if places[last] - first == end - start else "partial_3"
        if first < stop:
            out[k] = (first, stop, kind)
        if leave >= last:
            break
    return out


DIFF_SCORES = (1, -1, -5, -1)


def edits(observed: str, expected: str, terminal: str | None = None) -> list[tuple[int, int, str, str]]:
    """Edits that lead from expected to observed: (place, order, expected bases, observed bases).

    Places are 0-based on the expected sequence; order sorts substitutions before insertions
    before deletions at one place. ``terminal`` leaves out deletions at the "leading" or
    "trailing" end, or at "both".
    """
    if observed == expected:
        return []
    match, mismatch, gap_open, gap_extend = DIFF_SCORES
    n = len(observed)
    if n == len(expected) and sum(a != b for a, b in zip(observed, expected)) <= 5:
        # with so few mismatches no gapped alignment scores as high
        return [(i, 0, b, a) for i, (a, b) in enumerate(zip(observed, expected)) if a != b]
    x, y = observed.encode("latin-1", "replace"), expected.encode("latin-1", "replace")
    table = np.full((256, 256), mismatch, np.int32)
    np.fill_diagonal(table, match)
    best, ins, dele = _fill(np.frombuffer(x, np.uint8)[None, :], np.frombuffer(y, np.uint8), table, gap_open, gap_extend, False)
    path = _trace(x, y, best[:, :, 0], ins[:, :, 0], dele[:, :, 0], table, gap_open, gap_extend, len(y), False)
    out: list[list] = []
    last = ""
    for i, j, op in path:
        if op == SUB:
            out.append([j - 1, 0, expected[j - 1], observed[i - 1]])
        elif op == INS:
            if last == INS:
                out[-1][3] += observed[i - 1]
            else:
                out.append([j, 1, "", observed[i - 1]])
        elif op == DEL:
            if last == DEL:
                out[-1][2] += expected[j - 1]
            else:
                out.append([j - 1, 2, expected[j - 1], ""])
        last = op
    kept = []
    for place, order, exp, obs in out:
        if order == 2 and terminal in ("leading", "both") and place == 0:
            continue
        if order == 2 and terminal in ("trailing", "both") and place + len(exp) == len(expected):
            continue
        kept.append((place, order, exp, obs))
    return kept


def edits_text(items: Sequence[tuple[int, int, str, str]]) -> str:
    """Edits as text: substitutions count places from 1, insertions and deletions from 0."""
    out = []
    for place, order, exp, obs in items:
        if order == 0:
            out.append(f"{place + 1}{exp}>{obs}")
        elif order == 1:
            out.append(f"{place}_{place + 1}_ins{obs}")
        else:
            out.append(f"{place}_{place + len(exp) - 1}_del{exp}")
    return ";".join(out)


#: Extra expected bases beside a fragment when it is compared on its own.
WINDOW = 8


#: Which deletions at the ends are left out of each kind of region, since they only tell what was not read.
UNREAD = {"complete": None, "partial_5": "leading", "partial_3": "trailing"}


def variants(observed: str | None, kind: str | None, expected: str | None, distance: int) -> str | None:
    """Edits between a found region and its library sequence. Fragments on either side of a gap are compared
    at their own end; what both of two overlapping ones show is told once."""
    if observed is None or expected is None:
        return None
    if kind in UNREAD:
        return edits_text(edits(observed, expected, UNREAD[kind]))
    found = []
    for fragment, unread in zip(observed.split("/", 1), ("trailing", "leading")):
        reach = min(len(fragment) + distance + WINDOW, len(expected))
        at = 0 if unread == "trailing" else len(expected) - reach
        found += [(place + at, *what) for place, *what in edits(fragment, expected[at : at + reach], unread)]
    if kind == "overlapping":
        found = sorted(dict.fromkeys(found), key=lambda e: e[:2])
    return edits_text(found)
