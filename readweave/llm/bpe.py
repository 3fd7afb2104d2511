"""Byte-level BPE ids of whole texts with a public tokenizer."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary lies by default.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept per worker before its cache starts anew; a matter of memory, not of results.
CACHE = 400_000
#: Cells of a matrix of pieces; a matter of memory, not of results.
CELLS = 1 << 19
_NONE = np.int32(2**31 - 1)


def load_merges(path: str = VOCABULARY) -> dict:
    """Ids of single bytes, and (left id, right id, merged id) in merge order, of a byte-level BPE file; and a token that tells files apart."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    # the printable stand-in of each byte: itself where printable, else the next code from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int64).reshape(-1, 3)
    single = np.array([vocab[shown[b]] for b in range(256)], np.int32)
    return {"bytes": single, "merges": merges, "token": hashlib.sha256(single.tobytes() + merges.tobytes()).hexdigest()}


class PairTable:
    """Hash table from (left id, right id) to merge rank, probed by whole arrays."""

    BITS = 19

    def __init__(self, merges: np.ndarray) -> None:
        keys = (merges[:, 0].astype(np.uint64) << np.uint64(32)) | merges[:, 1].astype(np.uint64)
        self.keys = np.full(1 << self.BITS, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.BITS, _NONE, np.int32)
        self.probes = 1
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        mask = (1 << self.BITS) - 1
        while len(todo):
            free = self.ranks[slot[todo]] == _NONE
            _, winners = np.unique(slot[todo][free], return_index=True)
            placed = todo[free][winners]
            self.keys[slot[placed]], self.ranks[slot[placed]] = keys[placed], placed
            left = np.ones(len(keys), bool)
            left[placed] = False
            todo = todo[left[todo]]
            if len(todo):
                slot[todo] = (slot[todo] + 1) & mask
                self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs; pairs that do not merge, and padding (-1), get the largest int."""
        keys = (left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], _NONE)
        for _ in range(self.probes - 1):
            miss = np.flatnonzero((out == _NONE) & (self.ranks[slot] != _NONE))
            if not len(miss):
                break
            slot.flat[miss] = (slot.flat[miss] + 1) & (len(self.ranks) - 1)
            hit = self.keys[slot.flat[miss]] == keys.flat[miss]
            out.flat[miss[hit]] = self.ranks[slot.flat[miss[hit]]]
        return out


class Encoder:
    """Encodes texts; distinct pieces are merged once, together, in length-bucketed matrices."""

    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray, cache: int = CACHE) -> None:
        self.byte_ids, self.merged = byte_ids.astype(np.int32), merges[:, 2].astype(np.int32)
        self.table = PairTable(merges)
        self.split = regex.compile(PATTERN).findall
        self.cache = cache
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.lens = np.empty(1 << 14, np.int64)

    def merge_rows(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        """Ids of each piece. Pieces of similar length form one padded matrix, whatever the length; in every
        round each row merges its pairs of least rank, and rows without a pair leave."""
        out: list = [None] * len(pieces)
        lens = np.array([len(p) for p in pieces])
        # lengths are rounded up to one of eight steps within each power of two: at most an eighth is padding
        step = 2 ** np.maximum(np.floor(np.log2(np.maximum(lens, 1))).astype(np.int64) - 3, 0)
        width = np.maximum(-(-lens // step) * step, 1)
        for w in np.unique(width):
            places = np.flatnonzero(width == w)
            rows = max(CELLS // int(w), 1)
            for at in range(0, len(places), rows):
                self._merge_matrix([pieces[i] for i in places[at : at + rows]], int(w), places[at : at + rows], out)
        return out

    def _merge_matrix(self, pieces: list[bytes], w: int, rows: np.ndarray, out: list) -> None:
        """Merge the rows of one matrix.

        A row's leftmost pair of least rank comes first, then the next pair of that rank, and
        so on: a merge only makes pairs of higher rank, so all of them are done in one round
        (of neighbouring ones, which share an id, every second from the left)."""
        raw = np.array(pieces, dtype=f"S{w}").view(np.uint8).reshape(len(pieces), w)
        lens = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(w) < lens[:, None], self.byte_ids[raw], -1).astype(np.int32)
        ranks = np.full(ids.shape, _NONE)
        ranks[:, :-1] = self.table.ranks_of(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = ranks.min(1)
            done = best == _NONE
            if done.any():
                for i, row, n in zip(rows[done], ids[done], lens[done]):
                    out[i] = row[:n]
                ids, ranks, rows, best, lens = ids[~done], ranks[~done], rows[~done], best[~done], lens[~done]
                if not len(rows):
                    break
            line, at = np.nonzero(ranks == best[:, None])
            flat = line * ids.shape[1] + at
            start = np.r_[True, np.diff(flat) > 1]
            run = np.arange(len(flat)) - np.maximum.accumulate(np.where(start, np.arange(len(flat)), 0))
            line, at = line[run % 2 == 0], at[run % 2 == 0]
            ids[line, at] = self.merged[best[line]]
            keep = np.arange(ids.shape[1]) < lens[:, None]
            keep[line, at + 1] = False
            lens = keep.sum(1)
            # compaction: what is kept moves to the left, and the matrix narrows to its longest row
            moved = (np.cumsum(keep, 1) - 1)[line, at]
            inside = np.arange(int(lens.max())) < lens[:, None]
            new_ids, new_ranks = np.full(inside.shape, -1, np.int32), np.full(inside.shape, _NONE)
            new_ids[inside], new_ranks[inside] = ids[keep], ranks[keep]
            ids, ranks = new_ids, new_ranks
            for row, place in ((line, moved), (line[moved > 0], moved[moved > 0] - 1)):
                last = place >= lens[row] - 1
                ranks[row[last], place[last]] = _NONE
                row, place = row[~last], place[~last]
                ranks[row, place] = self.table.ranks_of(ids[row, place], ids[row, place + 1])

    def _add(self, new: list[str]) -> None:
        """Merge pieces met for the first time and append their ids to the flat store."""
        done = self.merge_rows([p.encode("utf-8", "surrogatepass") for p in new])
        first = len(self.index) - len(new)
        lens = np.fromiter(map(len, done), np.int64, len(done))
        need, total = len(self.index), self.used + int(lens.sum())
        if need > len(self.starts):
            size = max(need, 2 * len(self.starts))
            self.starts, self.lens = (np.concatenate([a, np.empty(size - len(a), np.int64)]) for a in (self.starts, self.lens))
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(total, 2 * len(self.flat)) - self.used, np.int32)])
        self.starts[first:need] = self.used + np.cumsum(lens) - lens
        self.lens[first:need] = lens
        self.flat[self.used : total] = np.concatenate(done)
        self.used = total

    def _places(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cache places of all pieces of the texts in a row, and the number of pieces of each text."""
        if len(self.index) > self.cache:
            self._reset()
        index, new, parts, sizes = self.index, [], [], []
        for text in texts:
            pieces = self.split(text) if text else ()
            try:
                part = [index[p] for p in pieces]
            except KeyError:
                for p in pieces:
                    if p not in index:
                        index[p] = len(index)
                        new.append(p)
                part = [index[p] for p in pieces]
            parts.append(np.array(part, np.int64))
            sizes.append(len(part))
        if new:
            self._add(new)
        return np.concatenate(parts) if parts else np.empty(0, np.int64), np.array(sizes, np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets at which each text starts."""
        places, sizes = self._places(texts)
        lens = self.lens[places]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(self.starts[places] - (ends - lens), lens)
        marks = np.r_[0, np.cumsum(sizes)]
        offsets = np.r_[0, ends][marks] if len(ends) else np.zeros(len(sizes) + 1, np.int64)
        return self.flat[where], offsets

    def count(self, texts: Sequence[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        places, sizes = self._places(texts)
        marks = np.r_[0, np.cumsum(sizes)]
        return np.diff(np.r_[0, np.cumsum(self.lens[places])][marks])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(merges: dict) -> Encoder:
    """The encoder of this worker process; the merges arrive once as a broadcast of about 1 MB."""
    if merges["token"] not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[merges["token"]] = Encoder(merges["bytes"], merges["merges"])
    return _ENCODERS[merges["token"]]


def _blocks(texts: pa.Array, most: int = 1 << 22) -> Iterator[list[str | None]]:
    """The texts in blocks of about 4 million characters, so that memory follows the block, not the batch."""
    block, size = [], 0
    for text in texts:
        value = text.as_py()
        block.append(value)
        size += len(value or "")
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def token_ids(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """The ids of a text by a byte-level BPE file, without special tokens, as array<int>.

    Whole texts are encoded; strings that look like special tokens are ordinary text. Null and
    empty texts give an empty array. The vocabulary is read on the driver and broadcast: its
    size is fixed.
    """
    shared = spark.sparkContext.broadcast(load_merges(path))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value)
        for part in parts:
            ids, sizes = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
            for block in _blocks(part):
                flat, offsets = encoder.encode(block)
                ids.append(flat)
                sizes.append(np.diff(offsets))
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))

    return run(text)


def token_count(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """The number of ids of a text; 0 for null and empty texts."""
    shared = spark.sparkContext.broadcast(load_merges(path))

    @F.arrow_udf(T.IntegerType())
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value)
        for part in parts:
            counts = [np.empty(0, np.int64), *(encoder.count(block) for block in _blocks(part))]
            yield pa.array(np.concatenate(counts), pa.int32())

    return run(text)
