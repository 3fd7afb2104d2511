"""Variable regions found by the fixed sequences beside them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from readweave.operators.spec import Flanks


def match_places(reads: np.ndarray, pattern: bytes, tolerance: int) -> np.ndarray:
    """For reads of one length, a row per read that tells at which places the pattern fits within the tolerance."""
    n = reads.shape[1] - len(pattern) + 1
    if n <= 0:
        return np.zeros((len(reads), 0), bool)
    wrong = np.zeros((len(reads), n), np.int16)
    for k, base in enumerate(pattern):
        wrong += reads[:, k : k + n] != base
    return wrong <= tolerance


def _next(places: np.ndarray, at: int) -> int | None:
    """First fitting place from ``at`` on."""
    if at >= len(places):
        return None
    k = int(places[at:].argmax())
    return at + k if places[at + k] else None


def _opening(before: list, after: list, flanks: Sequence[Flanks]) -> tuple[int, int, bool] | None:
    """Earliest place at which any flank fits: (place, region, whether it is the flank before the
    region). At one place earlier regions, and of one region the flank before it, come first."""
    found = []
    for i, flank in enumerate(flanks):
        for places, is_before in ((before[i], True), (after[i], False)):
            # the end of the last region is told by what precedes it; a region with both flanks by either
            if places is None or (not is_before and flank.after is None):
                continue
            at = _next(places, 0)
            if at is not None:
                found.append((at, i, 0 if is_before else 1))
    if not found:
        return None
    at, i, second = min(found)
    return at, i, second == 0


def find_regions(length: int, before: list, after: list, flanks: Sequence[Flanks]) -> list[tuple[int, int, str] | None]:
    """(start, end, completeness) of every region in one read, given where its flanks fit.

    The scan starts at the earliest flank. A flank behind a region met first means the read
    begins inside that region. From there regions follow one another: the flank before, then the
    one behind; the first flank that is missing ends the scan, and a region left open runs to
    the end of the read.
    """
    out: list[tuple[int, int, str] | None] = [None] * len(flanks)
    opening = _opening(before, after, flanks)
    if opening is None:
        return out
    at, region, opened = opening
    if not opened:
        out[region] = (0, at, "partial_5")
        region += 1
    first = opened
    while region < len(flanks):
        flank = flanks[region]
        start = at if first else _next(before[region], at)
        first = False
        if start is None or flank.before is None:
            break
        start += len(flank.before)
        if flank.after is None:
            out[region] = (start, length, "partial_3")
            break
        close = _next(after[region], start)
        if close is None:
            out[region] = (start, length, "partial_3")
            break
        out[region] = (start, close, "complete")
        at, region = close, region + 1
    return out


def pattern_regions(reads: Sequence[str | None], flanks: Sequence[Flanks], tolerance: int) -> list[list[tuple[int, int, str] | None]]:
    """Regions of many reads; reads of one length are matched together."""
    out: list = [[None] * len(flanks) for _ in reads]
    by_length: dict[int, list[int]] = {}
    raw = [None if r is None else r.encode("latin-1", "replace") for r in reads]
    for i, r in enumerate(raw):
        if r:
            by_length.setdefault(len(r), []).append(i)
    for length, places in by_length.items():
        block = np.frombuffer(b"".join(raw[i] for i in places), np.uint8).reshape(len(places), length)
        before = [None if f.before is None else match_places(block, f.before.encode(), tolerance) for f in flanks]
        after = [None if f.after is None else match_places(block, f.after.encode(), tolerance) for f in flanks]
        for k, i in enumerate(places):
            out[i] = find_regions(length, [b if b is None else b[k] for b in before], [a if a is None else a[k] for a in after], flanks)
    return out
