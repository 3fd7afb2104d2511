"""Languages of documents and of their segments: known words first, then shorter and shorter n-grams."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The two- and three-letter ISO 639 codes of each language.
CODES = {
    "en": ("en", "eng"),
    "de": ("de", "deu", "ger"),
    "fr": ("fr", "fra", "fre"),
    "es": ("es", "spa"),
    "pt": ("pt", "por"),
    "it": ("it", "ita"),
    "nl": ("nl", "nld", "dut"),
    "pl": ("pl", "pol"),
    "ru": ("ru", "rus"),
}
LONGEST = 5
#: Weight of a word that training did not hold.
UNKNOWN = 0.6
#: Posterior from which a line or run of lines of fewer words than asked for is a segment of its own.
DECISIVE = 0.99
#: Log likelihood a switch of language within a line must gain, and the words either side must have.
SWITCH, SIDE = 12.0, 3
#: What is written in none of the languages: texts of whose words' n-grams of three letters and more training
#: held fewer than a quarter, such as other scripts and chance letters. Lines of the languages reach 0.65.
NONE, STRANGE = "und", 0.75
CACHE = 300_000
#: Letters scored at once; a matter of memory, not of results.
BLOCK = 1 << 20
_WORDS = re.compile(r"[^\W\d_]+").findall
_WORDS_AND_ENDS = re.compile(r"[^\W\d_]+|\n").findall


#: What two-byte UTF-8 looks like when it was decoded as a western single-byte charset.
_ODD = re.compile("[\u00c2-\u00c5\u00d0\u00d1][\u0080-\u00bf\u0152-\u017e\u02c6-\u02dc\u2010-\u2122]")


def named_language(lang: Column) -> Column:
    """The two-letter code a label names, or null: a two- or three-letter code in any case, with or without a country."""
    code = F.regexp_extract(F.lower(F.coalesce(lang, F.lit(""))), r"\A([a-z]{2,3})(?:[-_](?:[a-z]{2}|[0-9]{3}))?\z", 1)
    pairs = [F.lit(x) for two, all_codes in CODES.items() for c in all_codes for x in (c, two)]
    return F.element_at(F.create_map(*pairs), F.when(code != "", code))


def repaired(line: str) -> str:
    """The line, decoded anew if it reads like UTF-8 taken for a western single-byte charset."""
    odd = len(_ODD.findall(line))
    if not odd:
        return line
    raw, lost = bytearray(), 0
    for ch in line:
        try:
            raw += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) < 256:
                raw.append(ord(ch))
            else:
                raw += b"?"
                lost += 1
    text = raw.decode("utf-8", "replace")
    return text if (text.count("\ufffd") + lost) * 4 <= odd else line


class Model:
    """Per-language log frequencies of words and of character n-grams of padded words.

    ``temper`` divides scores before they become posteriors; it is the one under which held-out
    chunks of samples are most likely.
    """

    def __init__(self, samples: Iterable[tuple[str, str]], folds: int = 3) -> None:
        rows = [(lang, text) for lang, text in samples if lang is not None and text is not None]
        counts: dict[int, dict[str, Counter]] = {n: defaultdict(Counter) for n in range(LONGEST + 1)}
        for lang, text in rows:
            for word in _WORDS(text.lower()):
                counts[0][word][lang] += 1
                padded = f" {word} "
                for n in range(1, LONGEST + 1):
                    for k in range(len(padded) - n + 1):
                        counts[n][padded[k : k + n]][lang] += 1
        self.langs = sorted({lang for lang, _ in rows})
        #: Of words (0) and n-grams of each length: their row in ``scores``.
        self.index: list[dict[str, int]] = []
        self.scores: list[np.ndarray] = []
        for n in range(LONGEST + 1):
            totals = Counter()
            for c in counts[n].values():
                totals.update(c)
            kinds = len(counts[n]) + 1
            self.index.append({g: i for i, g in enumerate(counts[n])})
            table = [[math.log((c[x] + 0.05) / (totals[x] + 0.05 * kinds)) for x in self.langs] for c in counts[n].values()]
            self.scores.append(np.array(table, np.float32).reshape(len(table), len(self.langs)))
        self.temper = 1.0
        self.token = uuid.uuid4().hex
        if folds > 1 and len(rows) >= 10 * folds and len(self.langs) > 1:
            self._calibrate(rows, folds)

    def words(self, words: Sequence[str]) -> np.ndarray:
        """Scores of words, and in the last column how strange each is.

        A word training held has its own log frequencies; another those of its n-grams, the
        longest first: the share of an order's n-grams that is known is their weight, and what
        it leaves falls to the next shorter order, so a name that shares one chance n-gram says
        little. Scores are relative to the best language's."""
        out = np.zeros((len(words), len(self.langs) + 1), np.float32)
        own = np.array([self.index[0].get(w, -1) for w in words], np.int64)
        known = own >= 0
        if known.any():
            out[known, :-1] = self.scores[0][own[known]] - self.scores[0][own[known]].max(1, keepdims=True)
        new = np.flatnonzero(~known)
        padded = [f" {words[i]} " for i in new]
        weight = np.full(len(new), UNKNOWN)
        for n in range(LONGEST, 0, -1):
            get, rows, got = self.index[n].get, [], np.zeros(len(new), np.int64)
            for i, p in enumerate(padded):
                found = [r for k in range(len(p) - n + 1) if (r := get(p[k : k + n])) is not None]
                rows += found
                got[i] = len(found)
            some = np.flatnonzero(got)
            if len(some):
                mean = np.add.reduceat(self.scores[n][rows], np.r_[0, np.cumsum(got[some])[:-1]], axis=0) / got[some, None]
                share = got[some] / np.array([len(padded[i]) - n + 1 for i in some])
                out[new[some], :-1] += (weight[some] * share)[:, None] * (mean - mean.max(1, keepdims=True))
                weight[some] *= 1 - share
            if n == 3:
                out[new, -1] = weight / UNKNOWN
        return out

    def _calibrate(self, rows: list[tuple[str, str]], folds: int) -> None:
        """Fit ``temper`` on chunks of 1 to 8 words of samples a model of the other folds has not seen."""
        scores, truth = [], []
        for fold in range(folds):
            rest = Model([r for i, r in enumerate(rows) if i % folds != fold], folds=0)
            at = {x: rest.langs.index(x) for x in self.langs if x in rest.langs}
            for lang, text in rows[fold::folds]:
                words = _WORDS(text.lower())
                if lang not in at or len(rest.langs) != len(self.langs) or not words:
                    continue
                table = rest.words(words)
                for size in (1, 2, 4, 8):
                    for k in range(0, len(words) - size + 1, size):
                        scores.append(table[k : k + size, :-1].sum(0))
                        truth.append(at[lang])
        if not scores:
            return
        s, t = np.array(scores, float), np.array(truth)
        grid = np.exp(np.linspace(math.log(0.5), math.log(8), 41))
        loss = [(np.log(np.exp((s - s.max(1, keepdims=True)) / g).sum(1)) - (s[np.arange(len(t)), t] - s.max(1)) / g).mean() for g in grid]
        self.temper = float(grid[int(np.argmin(loss))])

    def posterior(self, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Calibrated posterior of language ``at`` of each row of summed scores."""
        gap = (sums - np.take_along_axis(sums, at[:, None], 1)) / self.temper
        return 1 / np.exp(np.minimum(gap, 50.0)).sum(1)


def repaired(line: str) -> str:
    """The line, decoded anew if it reads like UTF-8 taken for a western single-byte charset."""
    odd = len(_ODD.findall(line))
    if not odd:
        return line
    raw, lost = bytearray(), 0
    for ch in line:
        try:
            raw += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) < 256:
                raw.append(ord(ch))
            else:
                raw += b"?"
                lost += 1
    text = raw.decode("utf-8", "replace")
    return text if (text.count("\ufffd") + lost) * 4 <= odd else line


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0) if len(starts) else values[:0]


@dataclass
class _Units:
    """Lines, or pieces of lines in one language: text, line, word bounds, blank-separated words of whole lines."""

    doc: np.ndarray
    line: np.ndarray
    first: np.ndarray
    last: np.ndarray
    blanks: np.ndarray
    piece: np.ndarray

    def take(self, at: np.ndarray) -> _Units:
        return _Units(self.doc[at], self.line[at], self.first[at], self.last[at], self.blanks[at], self.piece[at])


class Labeller:
    """Labels texts with a model, whole blocks of them at once; scores of words are kept between blocks."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {"\n": 0}
        self.rows = np.zeros((1 << 12, len(self.model.langs) + 1), np.float32)

    def _learn(self, new: list[str]) -> None:
        at = len(self.index)
        self.index.update((w, at + i) for i, w in enumerate(new))
        while len(self.rows) < len(self.index):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at : at + len(new)] = self.model.words(new)

    def _lines(self, texts: Sequence[str]) -> tuple[np.ndarray, _Units]:
        """Running sums of the scores of all words, and the lines as units."""
        if len(self.index) > CACHE:
            self._reset()
        raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.flatnonzero(raw == 10)
        gap = (raw == 32) | (raw == 10)
        begins = np.cumsum(~gap & np.r_[True, gap[:-1]])
        blanks = np.diff(np.r_[0, begins[ends]])
        words: list[str] = []
        for text in texts:
            if _ODD.search(text):
                text = "\n".join(map(repaired, text.split("\n")))
            words += _WORDS_AND_ENDS(text.lower())
            words.append("\n")
        new = [w for w in set(words) if w not in self.index]
        if new:
            self._learn(sorted(new))
        index = self.index
        flat = np.array([index[w] for w in words], np.int64)
        total = np.zeros((len(flat) + 1, self.rows.shape[1]))
        np.cumsum(self.rows[flat], axis=0, dtype=np.float64, out=total[1:])
        stops = np.flatnonzero(flat == 0)
        number = np.array([t.count("\n") + 1 for t in texts])
        doc = np.repeat(np.arange(len(texts)), number)
        line = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
        return total, _Units(doc, line, np.r_[0, stops[:-1] + 1], stops, blanks, np.zeros(len(doc), bool))

    def _split(self, total: np.ndarray, units: _Units) -> _Units:
        """Cut units where a switch of language gains enough, until none does."""
        total, done, todo = total[:, :-1], [], units
        while len(todo.doc):
            size = todo.last - todo.first
            whole = (total[todo.last] - total[todo.first]).max(1)
            # a word's best score is 0, so a line cannot gain more than it lacks
            some = np.flatnonzero((size >= 2 * SIDE) & (-whole >= SWITCH))
            gain, cut = np.full(len(size), -np.inf), np.zeros(len(size), np.int64)
            if len(some):
                n = size[some] - 2 * SIDE + 1
                owner = np.repeat(some, n)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + todo.first[owner] + SIDE
                value = (total[at] - total[todo.first[owner]]).max(1) + (total[todo.last[owner]] - total[at]).max(1)
                starts = np.cumsum(n) - n
                best = np.maximum.reduceat(value, starts)
                place = np.minimum.reduceat(np.where(value == np.repeat(best, n), at, len(total)), starts)
                gain[some], cut[some] = best - whole[some], place
            go = gain >= SWITCH
            done.append(todo.take(np.flatnonzero(~go)))
            left, right = todo.take(np.flatnonzero(go)), todo.take(np.flatnonzero(go))
            left.last, right.first = cut[go], cut[go]
            todo = _Units(*(np.r_[a, b] for a, b in zip(vars(left).values(), vars(right).values())))
            todo.piece[:], todo.blanks[:] = True, 0
        out = _Units(*(np.concatenate(c) for c in zip(*(vars(u).values() for u in done))))
        return out.take(np.lexsort((out.first, out.line, out.doc)))

    def label(self, texts: Sequence[str], least_words: int) -> dict[str, np.ndarray]:
        """Segments of all texts in order, the languages of long lines, and the texts' own language and confidence."""
        model, none = self.model, len(self.model.langs)
        total, lines = self._lines(texts)

        def told(units: _Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sums = total[units.last] - total[units.first]
            size = units.last - units.first
            best = sums[:, :-1].argmax(1)
            best[(size >= SIDE) & (sums[:, -1] > STRANGE * size)] = none
            return sums, size, best

        _, size, best = told(lines)
        long = np.flatnonzero((lines.blanks >= least_words) & (size > 0) & (best != none))
        long_doc, long_lang = np.divmod(np.unique(lines.doc[long] * (none + 1) + best[long]), none + 1)
        units = self._split(total, lines)
        sums, size, best = told(units)
        sure = model.posterior(sums[:, :-1], np.minimum(best, none - 1)) >= DECISIVE
        # a line of enough words speaks for itself, and so does a piece of one, and a shorter line or a run of them
        # whose words decide; any other joins what comes before, or after
        own = (size > 0) & (units.piece | (units.blanks >= least_words) | (sure & (best != none)))
        starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (units.doc[1:] != units.doc[:-1])])
        run = np.cumsum(np.isin(np.arange(len(own)), starts)) - 1
        joint, words = _sums(sums, starts), _sums(size, starts)
        lead = joint[:, :-1].argmax(1)
        decided = ~own[starts] & (words > 0) & (model.posterior(joint[:, :-1], lead) >= DECISIVE) & (joint[:, -1] <= STRANGE * words)
        now = decided[run] & (size > 0)
        own |= now
        best[now] = lead[run[now]]
        docs = np.flatnonzero(np.r_[True, units.doc[1:] != units.doc[:-1]])
        any_own = np.maximum.reduceat(own.astype(np.int8), docs) > 0 if len(docs) else np.empty(0, bool)
        text_sums, text_words = _sums(sums, docs), _sums(size, docs)
        text_best = text_sums[:, :-1].argmax(1)
        text_best[(text_words >= SIDE) & (text_sums[:, -1] > STRANGE * text_words)] = none
        mute = ~any_own[units.doc] & (size > 0)
        own |= mute
        best[mute] = text_best[units.doc[mute]]
        # what is no segment of its own belongs to the one before it, or else to the next
        place = np.arange(len(own))
        before = np.maximum.accumulate(np.where(own, place, -1))
        after = np.minimum.accumulate(np.where(own, place, len(own))[::-1])[::-1]
        held = (before >= 0) & (units.doc[np.maximum(before, 0)] == units.doc)
        best = best[np.where(held, before, np.minimum(after, len(own) - 1))]
        keep = np.flatnonzero(text_words[units.doc] > 0)
        units, sums, size, best = units.take(keep), sums[keep], size[keep], best[keep]
        seg = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (units.doc[1:] != units.doc[:-1])]) if len(keep) else keep
        end = np.r_[seg[1:], len(keep)] - 1 if len(seg) else seg
        lang, seg_sums, seg_words = best[seg], _sums(sums, seg), _sums(size, seg)
        unknown = lang == none
        sure = model.posterior(seg_sums[:, :-1], np.minimum(lang, none - 1))
        sure[unknown] = (seg_sums[unknown, -1] / np.maximum(seg_words[unknown], 1)).clip(0, 1)
        seg_doc = units.doc[seg]
        # a text's language is the one of most words; its confidence their share times the surest segment's
        weight, surest = np.zeros((len(texts), none + 1)), np.zeros((len(texts), none + 1))
        np.add.at(weight, (seg_doc, lang), seg_words)
        np.maximum.at(surest, (seg_doc, lang), sure)
        top = np.where(weight[:, :-1].any(1), weight[:, :-1].argmax(1), none)
        row = np.arange(len(texts))
        return {
            "told": text_words > 0, "lang": top, "confidence": weight[row, top] / np.maximum(weight.sum(1), 1) * surest[row, top],
            "long_doc": long_doc, "long_lang": long_lang, "doc": seg_doc, "first_line": units.line[seg], "last_line": units.line[end],
            "first_word": units.first[seg] - lines.first[np.searchsorted(lines.first, units.first[seg], side="right") - 1], "seg_lang": lang,
            "seg_confidence": sure, "words": seg_words, "longest_line": np.maximum.reduceat(units.blanks, seg) if len(seg) else seg,
        }


SEGMENT = "struct<first_line:int,first_word:int,last_line:int,lang:string,confidence:double,words:int,longest_line:int>"
LABEL = f"struct<lang:string,confidence:double,line_langs:array<string>,segments:array<{SEGMENT}>>"


def _arrow(got: dict[str, np.ndarray], langs: Sequence[str], kept: np.ndarray, n: int) -> pa.StructArray:
    """The labels of n texts, of which the ``kept`` ones were labelled."""
    names = pa.array([*langs, NONE])

    def lang(codes: np.ndarray) -> pa.Array:
        return names.take(pa.array(codes, pa.int64()))

    def lists(docs: np.ndarray, values: pa.Array) -> pa.ListArray:
        sizes = np.bincount(kept[docs], minlength=n) if len(docs) else np.zeros(n, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)

    number = lambda x: pa.array(x, pa.int32())
    segments = pa.StructArray.from_arrays(
        [number(got["first_line"]), number(got["first_word"]), number(got["last_line"]), lang(got["seg_lang"]), pa.array(got["seg_confidence"], pa.float64()), number(got["words"]), number(got["longest_line"])],
        ["first_line", "first_word", "last_line", "lang", "confidence", "words", "longest_line"],
    )
    told, top, sure = np.zeros(n, bool), np.full(n, len(langs)), np.zeros(n)
    told[kept], top[kept], sure[kept] = got["told"], got["lang"], got["confidence"]
    return pa.StructArray.from_arrays(
        [lang(top), pa.array(sure), lists(got["long_doc"], lang(got["long_lang"])), lists(got["doc"], segments)],
        ["lang", "confidence", "line_langs", "segments"], mask=pa.array(~told),
    )


def label_texts(labeller: Labeller, texts: Sequence[str | None], least_words: int = 12) -> pa.StructArray:
    """Labels of texts, in blocks of about BLOCK letters."""
    out, block, size = [], [], 0

    def close() -> pa.StructArray:
        kept = np.array([i for i, t in enumerate(block) if t], np.int64)
        if not len(kept) or not labeller.model.langs:
            return pa.nulls(len(block), _TYPE)
        return _arrow(labeller.label([block[i] for i in kept], least_words), labeller.model.langs, kept, len(block))

    for text in texts:
        block.append(text)
        size += len(text or "")
        if size >= BLOCK:
            out.append(close())
            block, size = [], 0
    if block or not out:
        out.append(close())
    return pa.concat_arrays(out)


_SEGMENTS = [("first_line", pa.int32()), ("first_word", pa.int32()), ("last_line", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32()), ("longest_line", pa.int32())]
_TYPE = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("line_langs", pa.list_(pa.string())), ("segments", pa.list_(pa.struct(_SEGMENTS)))])


def train(samples: DataFrame, lang: str = "lang", text: str = "text", most: int = 20_000) -> Model:
    """Train on labelled samples, at most ``most`` of them: a bound for the driver, shared evenly.

    Every language gives its samples in order of a hash, all languages in turn, so each is held
    by as many as there is room for and none is cut off."""
    rows = samples.select(F.lower(samples[lang]).alias("l"), samples[text].alias("t")).where("l is not null and t is not null")
    turn = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("t"), "t"))
    some = rows.withColumn("turn", turn).where(F.col("turn") <= most)
    return Model([(r["l"], r["t"]) for r in some.orderBy("turn", "l").limit(most).collect()])


_LABELLERS: dict[str, Labeller] = {}


def _labeller(model: Model) -> Labeller:
    """The labeller of this worker process, whose scores of words last from task to task."""
    if model.token not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[model.token] = Labeller(model)
    return _LABELLERS[model.token]


def language_labels(spark: SparkSession, text: Column, model: Model, least_words: int = 12) -> Column:
    """The language of a text, its confidence, the languages of its long lines, and its segments of one language each.

    Words known from training score by their log frequency per language; an unknown word falls
    back to its character n-grams, the longest known ones first. A line of at least
    ``least_words`` blank-separated words is labelled by its own words (``line_langs`` holds the
    languages of all such lines), and so are shorter lines, alone or as a run between such lines,
    whose posterior is at least ``DECISIVE``; other lines belong to the segment around them.
    Within a line the language switches where that gains at least ``SWITCH`` in log likelihood with
    ``SIDE`` words on either side. Consecutive pieces of one language form a segment, from word
    ``first_word`` of ``first_line`` on, with the calibrated posterior as confidence. What is
    stranger than ``STRANGE`` is ``und``, with its strangeness as confidence.
    Lines that read like UTF-8 decoded with another charset are decoded anew for scoring. Texts
    that are null, empty or without a word have a null label. The model's size is bounded by the
    training samples, so it is broadcast.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T._parse_datatype_string(LABEL))
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = _labeller(shared.value)
        for part in parts:
            yield label_texts(labeller, part.to_pylist(), least_words)

    return run(text)
