"""Records whose short texts nearly agree, by Golay-code fuzzy hashing of anchored segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readweave.llm.golay import codeword_keys
from readweave.operators.skew import lookup_join
from readweave.session import cut, shuffle_partitions

#: Letters of an anchor and of the segment on either side of it (2 bits a letter, 22 of 23 bits).
ANCHOR, SEGMENT = 8, 11
#: Letters a segment cut off by the text's end must have, and those of a segment beside a block that moved.
PART, NEAR = 3, 6
#: Anchors per text: at least LEAST, and one in EVERY of all its places, those of least rank.
LEAST, EVERY = 21, 7
#: Texts below this length, too short for an anchor with a segment, also meet by their single grams: all of them, so exactly.
SHORT = ANCHOR + PART + 5
#: An anchor that more than one text in COMMON holds, and LARGE texts besides, may be part of a fixed piece.
COMMON, LARGE = 200, 500
#: Of a text with fixed pieces at most this share of anchors, in tenths, is marked; a family's texts have more.
PIECES = 5
FIXED = 1 << 24
_BUCKETS = 1 << (2 * ANCHOR)
_GRAMS = 1 << 10
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = (1 << (2 * SEGMENT)) - 1
#: Rows a partition is meant to hold, and rows of one anchor that are compared in one piece.
ROWS, BUCKET = 300_000, 20_000
#: Pairs of copies a task is meant to make of one class, per copy.
COPIES = 256


def _letters(texts: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2-bit codes of all letters, twice, and the lengths.

    ``pad`` columns precede and follow each text: in the first array they are 0, in the second
    they close the text to a ring, so that halves that changed places keep their segments.
    """
    lens = np.array([len(t) for t in texts])
    width = max(int(lens.max()), 1)
    raw = np.array(texts, dtype=f"S{width}").view(np.uint8).reshape(len(texts), width)
    codes = (raw >> 1) & 3  # A, C, T, G become 0, 1, 2, 3; any other letter gets some code
    codes = np.pad(codes, ((0, 0), (pad, pad + ANCHOR))).astype(np.int64)
    column = np.arange(-pad, width + pad + ANCHOR)
    codes[(column < 0) | (column >= lens[:, None])] = 0
    if not pad:
        return codes, codes, lens
    ring = np.take_along_axis(codes, column % np.maximum(lens, ANCHOR)[:, None] + pad, 1)
    return codes, ring, lens


def _windows(codes: np.ndarray, first: int, count: int, width: int) -> np.ndarray:
    """``count`` windows of ``width`` letters from column ``first`` on, as 2-bit numbers."""
    out = np.zeros((len(codes), count), np.int64)
    for k in range(width):
        out |= codes[:, first + k : first + k + count] << (2 * k)
    return out


def _by_length(texts: list[bytes], cells: int = 1 << 20) -> Iterator[np.ndarray]:
    """Places of the texts in blocks of like length, each of about ``cells`` letters."""
    lens = np.array([len(t) for t in texts])
    order = np.argsort(lens, kind="stable")
    start = 0
    while start < len(order):
        least = max(int(lens[order[start]]), 16)
        stop = start
        while stop < len(order) and lens[order[stop]] <= 2 * least and (stop - start + 1) * lens[order[stop]] <= cells or stop == start:
            stop += 1
        yield order[start:stop]
        start = stop


def key_counts(texts: list[bytes], gram: int) -> np.ndarray:
    """How many of the texts hold each of the 65,536 anchors, and how many of the short ones each of 1,024 kinds of grams."""
    out = np.zeros(_BUCKETS + _GRAMS, np.int64)

    def add(some: list[bytes], size: int, first: int, kinds: int) -> None:
        for block in _by_length(some):
            codes, _, lens = _letters([some[i] for i in block], 0)
            n = max(int(lens.max()) - size + 1, 1)
            wide = np.pad(codes, ((0, 0), (0, max(0, n + size - codes.shape[1]))))
            keys = _windows(wide, 0, n, size) % kinds
            keys[np.arange(n) >= np.maximum(lens - size + 1, 1)[:, None]] = kinds
            keys.sort(axis=1)
            keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = kinds
            out[first : first + kinds] += np.bincount(keys.ravel(), minlength=kinds + 1)[:kinds]

    add(texts, ANCHOR, 0, _BUCKETS)
    short = [t for t in texts if gram <= len(t) < SHORT]
    if short:
        add(short, gram, _BUCKETS, _GRAMS)
    return out


def anchor_ranks(counts: np.ndarray, texts: int) -> np.ndarray:
    """The order in which anchors are chosen: by hash, whatever the counts; FIXED marks those of fixed pieces.

    The mark is for primers and what overlaps them. It is heeded only in texts that are not
    made of marked anchors (see :func:`fuzzy_keys`), so a family of near duplicates keeps the
    anchors its members share, however large its part of all texts."""
    ids = np.arange(_BUCKETS, dtype=np.uint64)
    ranks = (((ids + np.uint64(1)) * _MIX) >> np.uint64(40)).astype(np.int64)
    return np.where(counts * COMMON > texts + LARGE * COMMON, FIXED | ranks, ranks)


def _least(order: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``chosen`` least ranks of each row."""
    n = order.shape[1]
    most = min(int(chosen.max()), n)
    at = np.argpartition(order, most - 1, axis=1)[:, :most] if most < n else np.tile(np.arange(n), (len(order), 1))
    ranked = np.take_along_axis(order, at, 1)
    by_rank = np.argsort(ranked, axis=1, kind="stable")
    at, ranked = np.take_along_axis(at, by_rank, 1), np.take_along_axis(ranked, by_rank, 1)
    row, col = np.nonzero((ranked < (np.int64(1) << 60)) & (np.arange(most) < chosen[:, None]))
    return row, at[row, col]


def fuzzy_keys(texts: list[bytes], ranks: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the text, key, form) rows of a batch: one per chosen anchor.

    Anchors are chosen by :func:`anchor_ranks`, those of fixed pieces after all others; a text
    made of marked anchors belongs to a family, and has as many again without heed to marks.

    A text's fingerprint is the list of its chosen anchors, each with the segments of 11
    letters before and after it as 22-bit words: together the key. The form tells how many letters
    the text has on either side, up to 11, and with bits 9 and 10 which side to leave out. What the words decode to is worked out where equal
    anchors meet (:func:`decoded`). Letters differ by one or two bits, so a segment with one
    changed letter still meets. Short texts have a row for each of their grams besides, of a form
    with bit 8 set.
    """
    places, keys, forms = ([np.empty(0, np.int64)] for _ in range(3))
    for block in _by_length(texts):
        codes, ring, lens = _letters([texts[i] for i in block], SEGMENT)
        n = max(int(lens.max()) - ANCHOR + 1, 1)
        anchors = _windows(codes, SEGMENT, n, ANCHOR)
        usable = np.maximum(lens - ANCHOR + 1, 1)
        inside = np.arange(n) < usable[:, None]
        order = np.where(inside, ranks[anchors], np.int64(1) << 60)
        chosen = np.maximum(LEAST, -(-usable // EVERY))
        row, at = _least(order, chosen)
        family = np.flatnonzero(((order & FIXED) > 0).sum(1) * 10 > usable * PIECES)
        if len(family):
            more, there = _least(order[family] & ~np.int64(FIXED), chosen[family])
            row, at = np.divmod(np.unique(np.r_[row * n + at, family[more] * n + there]), n)
        key = anchors[row, at] << (4 * SEGMENT)
        for shift, up in ((0, 2 * SEGMENT), (SEGMENT + ANCHOR, 0)):
            word = np.zeros(len(row), np.int64)
            for k in range(SEGMENT):
                word |= ring[row, at + shift + k] << (2 * k)
            key |= word << up
        rest = np.maximum(lens[row] - at - ANCHOR, 0)
        # a segment that begins with a fixed piece tells no more than its anchor; the other side does
        fixed = (order & FIXED) > 0
        fixed[family] = False
        last = usable[row] - 1
        left = fixed[row, np.where(at > 0, np.maximum(at - ANCHOR, 0), last)]
        right = fixed[row, np.where(at < last, np.minimum(at + ANCHOR, last), 0)]
        left, right = left & ~right, right & ~left
        places.append(block[row])
        keys.append(key)
        forms.append((right << 10) | (left << 9) | (np.minimum(at, SEGMENT) << 4) | np.minimum(rest, SEGMENT))
    short = np.array([i for i, t in enumerate(texts) if gram <= len(t) < SHORT], np.int64)
    if len(short):
        codes, _, lens = _letters([texts[i] for i in short], 0)
        n = int(lens.max()) - gram + 1
        grams = _windows(codes, 0, n, gram)
        grams[np.arange(n) >= (lens - gram + 1)[:, None]] = -1
        grams.sort(axis=1)
        grams[:, 1:][grams[:, 1:] == grams[:, :-1]] = -1
        row, at = np.nonzero(grams >= 0)
        places.append(short[row])
        keys.append(grams[row, at])
        forms.append(np.full(len(row), 1 << 8))
    return np.concatenate(places), np.concatenate(keys), np.concatenate(forms).astype(np.int64)


def decoded(groups: np.ndarray, keys: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all rows: every segment gives the indices of the codewords near its word.

    ``groups`` number what rows must share besides (anchor, field, cell). A segment runs around
    the text's ends, so that halves that changed places keep theirs; where it does, what lies
    before the end counts as a segment of its own, if it has PART letters. The NEAR letters next to
    the anchor are a segment as well: a block that moved is intact only up to its ends."""
    plain = np.flatnonzero(forms & (1 << 8))
    fuzzy = np.flatnonzero((forms & (1 << 8)) == 0)
    key, before, after = keys[fuzzy], (forms[fuzzy] >> 4) & 15, forms[fuzzy] & 15
    left, right = (key >> (2 * SEGMENT)) & _WORD, key & _WORD
    use = (forms[fuzzy] & (1 << 9)) == 0, (forms[fuzzy] & (1 << 10)) == 0
    rows, out = [plain], [(groups[plain] << 15) | (1 << 14)]
    for side, word, whole, some in (
        (0, left, 1, True),
        (1, right, 1, True),
        (0, left & ~((np.int64(1) << (2 * (SEGMENT - before))) - 1), 0, (before < SEGMENT) & (before >= PART)),
        (1, right & ((np.int64(1) << (2 * after)) - 1), 0, (after < SEGMENT) & (after >= PART)),
        (0, left & ~((1 << (2 * (SEGMENT - NEAR))) - 1), 0, before >= NEAR),
        (1, right & ((1 << (2 * NEAR)) - 1), 0, after >= NEAR),
    ):
        at = np.flatnonzero(use[side] & some)
        index = codeword_keys(word[at])
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :1]
        r, c = np.nonzero(new)
        rows.append(fuzzy[at[r]])
        # cut-off segments are apart from whole ones
        out.append((groups[fuzzy[at[r]]] << 15) | ((2 * side + whole) << 12) | index[r, c])
    return np.concatenate(rows), np.concatenate(out)


def sketches(texts: list[bytes], gram: int) -> np.ndarray:
    """248 parities of each text's distinct grams by hash, and its number of grams up to 255, in four numbers.

    One gram that only one of two texts has flips one parity, so texts whose parities differ in
    d places differ in at least d grams: a pair can be dismissed, never wrongly. 255 grams
    or more, or letters beyond ASCII, give 255, which dismisses nothing.
    """
    out = np.zeros((4, len(texts)), np.uint64)
    for block in _by_length(texts):
        part = [texts[i] for i in block]
        codes, _, lens = _letters(part, 0)
        n = max(int(lens.max()) - gram + 1, 1)
        wide = np.pad(codes, ((0, 0), (0, max(0, n + gram - codes.shape[1]))))
        grams = _windows(wide, 0, n, gram)
        grams[np.arange(n) >= (lens - gram + 1)[:, None]] = -1
        grams.sort(axis=1)
        grams[:, 1:][grams[:, 1:] == grams[:, :-1]] = -1
        bit = (((grams.astype(np.uint64) + np.uint64(7)) * _MIX) >> np.uint64(33)) % np.uint64(248)
        one = np.where(grams >= 0, np.uint64(1), np.uint64(0)) << (bit & np.uint64(63))
        for k in range(4):
            out[k, block] = np.bitwise_xor.reduce(np.where(bit >> np.uint64(6) == k, one, np.uint64(0)), axis=1)
        number = np.array([min(max(len(t) - gram + 1, 0), 255) if t.isascii() else 255 for t in part], np.uint64)
        out[3, block] |= number << np.uint64(56)
    return out.view(np.int64)


def may_be_alike(marks: np.ndarray, a: np.ndarray, b: np.ndarray, tenths: int) -> np.ndarray:
    """Whether the sketches of rows a and b leave room for a likeness of tenths / 10."""
    x = marks[:, a] ^ marks[:, b]
    x[3] &= np.int64((1 << 56) - 1)
    apart = np.bitwise_count(x.view(np.uint64)).sum(0, dtype=np.int64)
    count = (marks[3] >> 56) & 0xFF
    both = count[a] + count[b]
    return (apart * (10 + tenths) <= both * (10 - tenths)) | (count[a] == 255) | (count[b] == 255)


def cells(hot: np.ndarray, ids: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all rows, ``split[hot]`` times for those whose anchor or gram is split in so many parts.

    A row of part p goes to the cells {p, q} of all parts q, so any two rows share a cell."""
    times = split[hot]
    if (times == 1).all():
        return np.arange(len(hot)), np.zeros(len(hot), np.int64)
    row = np.repeat(np.arange(len(hot)), times)
    other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    part = (((ids.astype(np.uint64) * _MIX) >> np.uint64(40)) % times.astype(np.uint64)).astype(np.int64)[row]
    low, high = np.minimum(part, other), np.maximum(part, other)
    return row, high * (high + 1) // 2 + low


def pairs_of_keys(keys: np.ndarray, ids: np.ndarray, keep=None, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different ids that share a key, smaller id first, in blocks of bounded size.

    ``keep`` may dismiss pairs by their two rows. Runs of equal keys are found by one sort;
    round k pairs every row with the k-th next row of its run, so memory stays at the rows',
    however long a run is.
    """
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    same = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])] if len(keys) else np.empty(0, bool)
    keys, ids, order = keys[same], ids[same], order[same]
    last = np.searchsorted(keys, keys, side="right") - 1  # the last row of each row's run
    rows = np.flatnonzero(last > np.arange(len(keys)))
    got_a, got_b, held, k = [], [], 0, 1
    while len(rows):
        kept = rows if keep is None else rows[keep(order[rows], order[rows + k])]
        got_a.append(ids[kept])
        got_b.append(ids[kept + k])
        held += len(kept)
        k += 1
        rows = rows[rows + k <= last[rows]]
        if held >= block:
            yield _unique_pairs(np.concatenate(got_a), np.concatenate(got_b))
            got_a, got_b, held = [], [], 0
    if held:
        yield _unique_pairs(np.concatenate(got_a), np.concatenate(got_b))


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return a[new], b[new]


def shared_grams(left: list[str], right: list[str], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams that both texts of each row have, and that either has: exact, on whole texts."""
    both, either = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    a, b = [t.encode() for t in left], [t.encode() for t in right]
    wide = np.array([len(x) != len(s) or len(y) != len(t) for x, s, y, t in zip(a, left, b, right)], bool)
    if gram > 7:
        wide[:] = True
    for i in np.flatnonzero(wide):
        x, y = ({t[k : k + gram] for k in range(len(t) - gram + 1)} for t in (left[i], right[i]))
        both[i], either[i] = len(x & y), len(x | y)
    plain = np.flatnonzero(~wide)
    pair = [a[i] if len(a[i]) >= len(b[i]) else b[i] for i in plain]
    none = np.int64(2**62)
    for block in _by_length(pair, 1 << 19) if len(plain) else ():
        rows = plain[block]
        sets = []
        for texts in (a, b):
            part = [texts[i] for i in rows]
            lens = np.array([len(t) for t in part])
            width = max(int(lens.max()), gram)
            raw = np.array(part, dtype=f"S{width}").view(np.uint8).reshape(len(part), width).astype(np.int64)
            n = width - gram + 1
            grams = np.zeros((len(part), n), np.int64)
            for k in range(gram):
                grams |= raw[:, k : k + n] << (8 * k)
            grams[np.arange(n) >= (lens - gram + 1)[:, None]] = none
            grams.sort(axis=1)
            grams[:, 1:][grams[:, 1:] == grams[:, :-1]] = none
            sets.append(grams)
        joint = np.concatenate(sets, axis=1)
        count = (joint < none).sum(1)
        joint.sort(axis=1)
        twice = ((joint[:, 1:] == joint[:, :-1]) & (joint[:, 1:] < none)).sum(1)
        both[rows], either[rows] = twice, count - twice
    return both, either


def _frame(df: DataFrame) -> DataFrame:
    return df.select(df["field"].cast("string").alias("field"), df["key"].cast("bigint").alias("key"), df["value"].cast("string").alias("value"))


def _classes(df: DataFrame) -> DataFrame:
    """One row per distinct (field, value): its class id is the smallest key."""
    return df.where(F.col("value").isNotNull() & F.col("key").isNotNull()).groupBy("field", "value").agg(F.min("key").alias("id"))


def _candidates(classes: DataFrame, gram: int, tenths: int) -> DataFrame:
    """Distinct (field, a, b) of classes that share a fuzzy key and whose sketches do not part them."""
    spark = classes.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for field, part in frame.groupby("field"):
                texts = [t.encode() for t in part["value"]]
                sums[field] = sums.get(field, 0) + key_counts(texts, gram)
                rows[field] = rows.get(field, 0) + np.array([sum(max(LEAST, -(-len(t) // EVERY)) for t in texts), len(texts)])
        for field, c in sums.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame({"field": field, "anchor": np.r_[-1, -2, used], "n": np.r_[rows[field], c[used]]}), preserve_index=False
            )

    # 66,562 counts per field at most, whatever the input holds
    counted = classes.select("field", "value").mapInArrow(count, "field string, anchor bigint, n bigint").groupBy("field", "anchor").agg(F.sum("n").alias("n")).toPandas()
    ranks: dict[str, tuple[int, np.ndarray, np.ndarray]] = {}
    for at, (field, part) in enumerate(sorted(counted.groupby("field"), key=lambda x: x[0])):
        counts = np.zeros(_BUCKETS + _GRAMS, np.int64)
        inner = part[part["anchor"] >= 0]
        counts[inner["anchor"].to_numpy()] = inner["n"].to_numpy()
        ranks[field] = (at, anchor_ranks(counts[:_BUCKETS], int(part.loc[part["anchor"] == -2, "n"].sum())), counts // BUCKET + 1)
    shared = spark.sparkContext.broadcast(ranks)
    rows = int(counted.loc[counted["anchor"] == -1, "n"].sum()) if len(counted) else 0
    parts = max(shuffle_partitions(spark), rows // ROWS + 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for field, part in frame.groupby("field"):
                number, order, split = shared.value[field]
                all_ids, texts = part["id"].to_numpy(), [t.encode() for t in part["value"]]
                for start in range(0, len(texts), 4096):
                    some, ids = texts[start : start + 4096], all_ids[start : start + 4096]
                    places, keys, forms = fuzzy_keys(some, order, gram)
                    marks = sketches(some, gram)
                    short = (forms & (1 << 8)) > 0
                    hot = np.where(short, _BUCKETS + keys % _GRAMS, keys >> (4 * SEGMENT))
                    which, cell = cells(hot, ids[places], split)
                    places, keys, forms, hot = places[which], keys[which], forms[which], hot[which]
                    # what rows must share: cell, field, and the anchor, or the gram of short texts
                    group = (cell << 30) | (np.int64(number) << 20) | hot
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group), pa.array(keys), pa.array(forms, pa.int16()), pa.array(ids[places]), *[pa.array(m[places]) for m in marks]],
                        ["bucket", "key", "form", "id", "m0", "m1", "m2", "m3"],
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in b.columns] for b in batches]
        if not got:
            return
        bucket, keys, forms, ids, *marks = (np.concatenate(x) for x in zip(*got))
        del got
        marks = np.array(marks)
        forms = forms.astype(np.int64)
        # grams of short texts share more than the 1,024 kinds they are counted by
        plain = np.where(forms & (1 << 8), keys, -1)
        order = np.lexsort((plain, bucket))
        bucket, keys, forms, ids, plain, marks = *(x[order] for x in (bucket, keys, forms, ids, plain)), marks[:, order]
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (plain[1:] != plain[:-1])]
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        ends = np.r_[starts[1:], len(bucket)]
        at = 0
        while at < len(starts):  # whole groups, about 100,000 rows at once
            stop = max(int(np.searchsorted(ends, starts[at] + 100_000, side="right")), at + 1)
            mine = np.arange(starts[at], ends[stop - 1])
            row, key = decoded(group[mine] - at, keys[mine], forms[mine])
            row = mine[row]
            field = (bucket >> 20) & 1023
            for f in np.unique(field[mine]):
                own = field[row] == f
                r = row[own]
                for a, b in pairs_of_keys(key[own], ids[r], lambda x, y: may_be_alike(marks, r[x], r[y], tenths)):  # noqa: B023
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), f, np.int32)), pa.array(a), pa.array(b)], ["f", "a", "b"])
            at = stop

    # rows meet by field and anchor and decode there: one row travels per anchor, not one per key. The rows of an
    # anchor that more than BUCKET texts hold are split, and every two parts of them meet in a cell of their own
    met = (
        classes.select("field", "id", "value")
        .mapInArrow(emit, "bucket bigint, key bigint, form smallint, id bigint, m0 bigint, m1 bigint, m2 bigint, m3 bigint")
        .repartition(parts, "bucket")
        .mapInArrow(meet, "f int, a bigint, b bigint")
        .dropDuplicates()
    )
    names = F.array(*[F.lit(f) for f in sorted(ranks)]) if ranks else F.array(F.lit(""))
    return met.select(F.get(names, F.col("f")).alias("field"), "a", "b")


def class_links(classes: DataFrame, gram: int, tenths: int) -> DataFrame:
    """Pairs of classes (field, a, b) whose likeness is at least tenths / 10, verified on the whole texts."""

    @F.arrow_udf(T.BooleanType())
    def alike(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in parts:
            both, either = shared_grams(left.to_pylist(), right.to_pylist(), gram)
            yield pa.array((either > 0) & (both * 10 >= either * tenths))

    met = _candidates(classes, gram, tenths)
    a = classes.select("field", F.col("id").alias("a"), F.col("value").alias("left"), F.col("copies").alias("a_copies"))
    b = classes.select("field", F.col("id").alias("b"), F.col("value").alias("right"), F.col("copies").alias("b_copies"))
    return met.join(a, ["field", "a"]).join(b, ["field", "b"]).where(alike("left", "right")).select("field", "a", "b", "a_copies", "b_copies")


def _rows(df: DataFrame) -> DataFrame:
    out = df.select(df["field"].cast("string").alias("field"), df["key"].cast("bigint").alias("key"), df["value"].cast("string").alias("value"))
    return out.where(F.col("key").isNotNull()).dropDuplicates()


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct (field, value), written once: its class id is the smallest key; with the number of its copies."""
    return cut(rows.where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("copies")))


def _members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row's key with what ``classes`` tell of its value (null for a null value)."""
    told = [c for c in classes.columns if c not in ("field", "value")]
    return lookup_join(rows, classes, ["field", "value"], "copies", "left").select("field", "key", *told)


def near_duplicate_classes(df: DataFrame, gram: int = 5, tenths: int = 6) -> DataFrame:
    """One row per row of ``df``: its class of exact copies, the class's rows and its links.

    ``df`` has ``field, key, value``, key unique within its field; the likeness of two values
    is the share of distinct ``gram``-letter substrings both have among those either has.

    Exact copies become one class before anything else. Each class gets Golay fuzzy keys (see
    :func:`fuzzy_keys`): of any two alike values most substrings agree, so among the anchors of
    least rank (21, or all places of a shorter text, or one place in 7 of a longer one) some are
    common to both, and of their two segments at least one lies on the side away from the next
    edit; up to two wrong bits in it are borne by the code. Classes that share a key are
    verified exactly on whole texts. No bucket is capped.

    Result: ``field, key, class_id`` (the smallest key with this value), ``copies`` and ``n_links``, the
    number of other classes whose likeness is at least ``tenths`` / 10. Null values have no class;
    values shorter than ``gram`` are alike to nothing. Repeated rows count once, rows without
    key not at all; an empty table gives an empty result.
    """
    rows = _rows(df)
    classes = _classes(rows)
    links = class_links(classes, gram, tenths)
    ends = links.select("field", F.explode(F.array("a", "b")).alias("id"))  # a union would find the links twice
    counts = ends.groupBy("field", "id").agg(F.count(F.lit(1)).alias("n"))
    linked = classes.join(counts, ["field", "id"], "left").select("field", "value", "id", "copies", F.coalesce("n", F.lit(0)).alias("n_links"))
    return _members(rows, cut(linked)).select("field", "key", F.col("id").alias("class_id"), "copies", "n_links")


def near_duplicate_pairs(df: DataFrame, gram: int = 5, tenths: int = 6) -> DataFrame:
    """All pairs of rows of one field whose values' likeness is at least ``tenths`` / 10.

    The links between classes of :func:`near_duplicate_classes`, expanded to their rows: copies
    pair with each other and with all rows of alike classes. A class of n copies has n * n / 2
    pairs; its rows are spread over n / COPIES parts, each of which meets the whole class, so no
    task makes more than about COPIES * n of them.

    Result: ``field, key_a, key_b`` with key_a < key_b. Null values and values shorter than
    ``gram`` are alike to nothing; repeated rows count once; an empty table gives no pairs.
    """
    rows = _rows(df)
    classes = _classes(rows)
    links = class_links(classes, gram, tenths)
    members = _members(rows.where(F.col("value").isNotNull() & (F.length("value") >= gram)), classes)

    def parts(copies: str) -> Column:
        return F.floor(F.col(copies) / COPIES).cast("int")

    def spread(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.floor(F.col("copies") / COPIES) + 1).cast("int")

    def every(copies: str) -> Column:
        return F.explode(F.sequence(F.lit(0), parts(copies)))

    one = members.select("field", F.col("id").alias("a"), F.col("key").alias("x"), spread("key").alias("part"))
    other = members.select("field", F.col("id").alias("b"), F.col("key").alias("y"), spread("key").alias("b_part"))
    again = members.select("field", F.col("id").alias("a"), F.col("key").alias("y"), every("copies").alias("part"))
    across = links.select("field", "a", "b", "b_copies", every("a_copies").alias("part")).join(one, ["field", "a", "part"])
    across = across.select("field", "b", "x", every("b_copies").alias("b_part")).join(other, ["field", "b", "b_part"])
    within = one.join(again, ["field", "a", "part"]).where(F.col("x") < F.col("y"))
    pairs = across.select("field", "x", "y").union(within.select("field", "x", "y"))
    return pairs.select("field", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
