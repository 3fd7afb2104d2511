import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readweave.llm import bpe, cooccurrence, frequent, golay, langid, neardup, packing, topn


def test_golay_distance_two_shares_a_key():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    other = words ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
    a, b = golay.codeword_keys(words), golay.codeword_keys(other)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))
    assert set(map(len, map(set, a.tolist()))) == {1, 6}


def grams(t):
    return {t[i : i + 5] for i in range(len(t) - 4)}


def brute(rows):
    """All pairs of rows of one field, their sets of grams as bits of a number."""
    bits, sets, out = {}, [], set()
    for _, _, v in rows:
        sets.append(sum(1 << bits.setdefault(g, len(bits)) for g in grams(v)) if v is not None else 0)
    for i, (f, k, _) in enumerate(rows):
        a = sets[i]
        for j in range(i + 1, len(rows)):
            if a and (b := sets[j]) and rows[j][0] == f and (a & b).bit_count() * 10 >= 6 * (a | b).bit_count():
                out.add((f, min(k, rows[j][1]), max(k, rows[j][1])))
    return out


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ACGT") for _ in range(n)) for n in [28] * 60 + [80] * 40]
    rows = [("x", i, v) for i, v in enumerate(base)]
    for v in base:
        at = rng.randrange(len(v))
        edits = [v[:at] + rng.choice("ACGT") + v[at + 1 :], v[:at] + v[at + 1 :], v[at:] + v[:at], v]
        rows += [("x", len(rows) + k, e) for k, e in enumerate(edits)]
    rows += [("x", 9000, None), ("x", 9001, ""), ("x", 9002, "ACG"), ("x", 9003, "AAAAAA"), ("x", 9004, "AAAAA"), ("x", 9005, "åäöåäöåä"), ("x", 9006, "åäöåäöåä"), ("y", 1, base[0])]
    rows += [("x", 9007, "A" * 5000 + "C"), ("x", 9008, "A" * 5000 + "G" + "C")]
    df = spark.createDataFrame(rows, "field string, key bigint, value string").withColumn("links", F.lit(1))
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df.union(df.limit(5))).collect()}
    expected = brute(rows)
    assert got == expected
    classes = {r["key"]: r for r in neardup.near_duplicate_classes(df.where("field = 'x'")).collect()}
    assert classes[9000]["class_id"] is None and classes[9006]["class_id"] == 9005 and classes[9006]["copies"] == 2
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0


def family(rng, size, edits=2, length=80):
    base, out = [rng.choice("ACGT") for _ in range(length)], set()
    while len(out) < size:
        text = list(base)
        for at in rng.sample(range(length), edits):
            text[at] = rng.choice([c for c in "ACGT" if c != base[at]])
        out.add("".join(text))
    return sorted(out)


@pytest.mark.parametrize("large, rows, sizes", [(500, 20_000, (50, 300)), (0, 20_000, (50, 300)), (0, 60, (50, 300)), (0, 20_000, (400,))])
def test_families_of_near_duplicates(spark, monkeypatch, large, rows, sizes):
    """Members share the commonest anchors of all; 300 are a third of the texts, 400 nearly half. Marks and splits are forced."""
    monkeypatch.setattr(neardup, "LARGE", large)
    monkeypatch.setattr(neardup, "BUCKET", rows)
    rng = random.Random(11)
    texts = [t for size in sizes for t in family(rng, size)]
    texts += ["".join(rng.choice("ACGT") for _ in range(80)) for _ in range(900 - len(texts))]
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "field string, key bigint, value string")
    got = {(r["key_a"], r["key_b"]) for r in neardup.near_duplicate_pairs(df).collect()}
    a, b = np.triu_indices(len(texts), 1)
    both, either = neardup.shared_grams([texts[i] for i in a], [texts[i] for i in b], 5)
    alike = both * 10 >= either * 6
    expected = set(zip(a[alike].tolist(), b[alike].tolist()))
    assert len(expected) > 20_000 and got <= expected and len(got) >= 0.995 * len(expected)


@pytest.mark.parametrize("length", [28, 40, 60, 80, 150])
def test_moved_blocks_at_every_length(spark, length):
    """Texts with halves swapped, a block moved within, or its two inner blocks swapped, besides an edit; none may be lost."""
    rng = random.Random(length)
    rows = []
    for k in range(120):
        v = "".join(rng.choice("ACGT") for _ in range(length))
        a, b = sorted(rng.sample(range(length // 4, length), 2))
        at = rng.randrange(length)
        rows += [v, v[a:] + v[:a], v[:a] + v[b:] + v[a:b], v[: at] + v[at + 1 :], v[a : a + 1] + v[1:a] + v[b:] + v[a:b]]
    rows = [("x", i, v) for i, v in enumerate(dict.fromkeys(rows))]
    expected = brute(rows)
    assert len(expected) > 100
    got = {tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, "field string, key bigint, value string")).collect()}
    assert got == expected


def test_an_anchor_in_every_text_is_split(spark, monkeypatch):
    """1,500 texts of one 30-letter primer and 50 own letters: the primer's anchors make no task of their own, and no pair is lost."""
    monkeypatch.setattr(neardup, "BUCKET", 100)
    rng = random.Random(9)
    primer = "".join(rng.choice("ACGT") for _ in range(30))
    own = ["".join(rng.choice("ACGT") for _ in range(50)) for _ in range(1450)]
    own += [v[:20] + v[21:] for v in own[:50]]
    texts = [primer + v for v in own]
    rows = [("x", i, t) for i, t in enumerate(texts)]
    got = {tuple(r)[1:] for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, "field string, key bigint, value string")).collect()}
    a, b = np.triu_indices(len(texts), 1)
    both, either = neardup.shared_grams([texts[i] for i in a], [texts[i] for i in b], 5)
    alike = both * 10 >= either * 6
    assert got == set(zip(a[alike].tolist(), b[alike].tolist())) and len(got) >= 50
    keys = [t.encode() for t in texts]
    counts = neardup.key_counts(keys, 5)
    _, key, form = neardup.fuzzy_keys(keys, neardup.anchor_ranks(counts[: 1 << 16], len(texts)), 5)
    rows_of = np.unique(key[(form & 256) == 0] >> 44, return_counts=True)[1]
    assert rows_of.max() < 500  # of 1,500 texts that hold the primer's anchors; a fourth share its end and their own first letter


def test_many_copies_are_spread(spark, monkeypatch):
    """A third of all rows are copies of one text; another copy group lies one edit from it."""
    monkeypatch.setattr(neardup, "COPIES", 16)
    rng = random.Random(12)
    hot = "".join(rng.choice("ACGT") for _ in range(60))
    values = [hot] * 200 + [hot[:30] + hot[31:]] * 40 + ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(360)] + [None, "", hot]
    rows = [("x", i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "field string, key bigint, value string")
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df.union(df)).collect()} == brute(rows)
    got = {r["key"]: tuple(r)[2:] for r in neardup.near_duplicate_classes(df).collect()}
    assert got[0] == (0, 201, 1) and got[602] == (0, 201, 1) and got[210] == (200, 40, 1) and got[300] == (300, 1, 0) and got[600] == (None, None, None)
    assert len(got) == len(rows)


def test_sketches_never_part_alike_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randint(5, 90))) for _ in range(150)]
    texts += [t[:7] + "A" + t[8:] for t in texts]
    raw = [t.encode() for t in texts]
    marks = neardup.sketches(raw, 5)
    a, b = map(np.array, zip(*[(i, j) for i in range(len(texts)) for j in range(i)]))
    keep = neardup.may_be_alike(marks, a, b, 6)
    both, either = neardup.shared_grams([texts[i] for i in a], [texts[j] for j in b], 5)
    assert all(keep[(either > 0) & (both * 10 >= either * 6)])
    assert [len(grams(texts[a[k]]) & grams(texts[b[k]])) for k in range(50)] == both[:50].tolist()


def test_cooccurrence(spark):
    rows = [("a", "x", 30), ("a", "y", 1), ("b", "y", 40), ("b", "x", None), (None, "x", 5), ("a", None, 2)]
    df = spark.createDataFrame(rows, "l string, r string, w bigint").withColumn("left", F.lit(0))
    got = {(r["left"], r["right"]): r for r in cooccurrence.cooccurrence(df, "l", "r", "w").collect()}
    assert (got["a", "x"]["n12"], got["a", "x"]["n1"], got["a", "x"]["n2"], got["a", "x"]["total"]) == (30, 31, 30, 71)
    assert got["b", "x"]["n12"] == 0 and got["b", "x"]["surprise"] == 0 and got["a", "x"]["surprise"] > 2
    plain = cooccurrence.cooccurrence(df, "l", "r", "w", null=False)
    assert "surprise" not in plain.columns and plain.count() == 4
    both = cooccurrence.with_false_discovery(cooccurrence.cooccurrence(df, "l", "r", "w")).collect()
    assert len(both) == 4 and all(0 <= r["q_value"] <= 1 for r in both)
    assert cooccurrence.discoveries(cooccurrence.cooccurrence(df.where("r is null"), "l", "r", "w"), 0.05).count() == 0
    assert cooccurrence.cooccurrence(df.limit(0), "l", "r", "w").count() == 0


def brute_null(rows):
    """The fitted null by plain iteration over every item and basket, and exact Poisson-binomial tails."""
    baskets = [s for l, r, w in rows for s in [(l is not None) + (r is not None)] * w if s]
    degree = {}
    for l, r, w in rows:
        for item in (("l", l), ("r", r)):
            if item[1] is not None:
                degree[item] = degree.get(item, 0) + w
    d, s = np.array(list(degree.values()), float), np.array(baskets, float)
    x, y = d / np.sqrt(d.sum()), s / np.sqrt(d.sum())
    for _ in range(3000):
        x = d / (y / (1 + np.outer(x, y))).sum(1)
        y = s / (x[:, None] / (1 + np.outer(x, y))).sum(0)
    at, two = {k: i for i, k in enumerate(degree)}, y[s == 2]

    def tails(l, r, k):
        p = [x[at[i]] * two / (1 + x[at[i]] * two) for i in (("l", l), ("r", r))]
        pmf = np.array([1.0])
        for q in p[0] * p[1]:
            pmf = np.convolve(pmf, [1 - q, q])[: 400]
        return pmf[k:].sum(), 1 - pmf[0]

    return tails


def test_null_against_brute_force(spark):
    """Surprise and false-discovery bound of every pair follow from the null fitted to all records, single ones included."""
    rng = random.Random(21)
    rows = [(f"l{rng.randrange(12)}", f"r{rng.randrange(9)}", rng.randrange(1, 4)) for _ in range(60)] + [("l1", "r1", 14), ("l20", "r20", 6)]
    rows += [("l1", None, 60), (None, "r2", 40), (None, None, 9)]
    df = spark.createDataFrame(rows, "l string, r string, w int")
    got = cooccurrence.with_false_discovery(cooccurrence.cooccurrence(df, "l", "r", "w")).collect()
    tails = brute_null(rows)
    p = {}
    for r in got:
        tail, seen = tails(r["left"], r["right"], r["n12"])
        assert abs(r["surprise"] + np.log10(tail)) < 0.06 * max(1, -np.log10(tail)), (r, tail)
        p[r["left"], r["right"]] = min(tail / seen, 1)
        closed = r["n1"] * r["n2"] / r["total"] ** 2
        if r["left"] == "l1":  # often alone: without its single records the null would expect it less
            assert tails("l1", r["right"], 1)[1] > 1 - (1 - closed) ** r["total"]
    order = sorted(p.values())
    for r in got:
        mine = p[r["left"], r["right"]]
        exact = min(min(q * len(p) / (i + 1) for i, q in enumerate(order) if q >= mine), 1)
        assert abs(np.log10(r["q_value"]) - np.log10(exact)) < 0.15 * max(1, -np.log10(exact))


def test_discoveries_reject_chance(spark):
    """Pairs that occur five times as often as expected by chance alone are rejected, planted ones are found."""
    rng = random.Random(5)
    rows = [(f"l{rng.randrange(400)}", f"r{rng.randrange(400)}", 1) for _ in range(6000)] + [("l7", "r7", 1)] * 25 + [("l8", "r9", 1)] * 12
    pairs = cooccurrence.cooccurrence(spark.createDataFrame(rows, "l string, r string, w int"), "l", "r", "w")
    often = {(r["left"], r["right"]) for r in pairs.where("lift >= 5").collect()}
    found = {(r["left"], r["right"]) for r in cooccurrence.discoveries(pairs, 0.05).collect()}
    assert len(often) > 1000 and {("l7", "r7"), ("l8", "r9")} <= found and len(found) <= 6


def test_surprise_against_exact_tail():
    import math

    n, q = 400, 0.02
    for k in (3, 8, 12, 20, 40):
        tail = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k, n + 1))
        got = cooccurrence.surprise(np.array([k]), np.array([[q]]), np.array([float(n)]))[0]
        assert abs(got + math.log10(tail)) < 0.03 * max(1, -math.log10(tail))
    mixed = cooccurrence.surprise(np.array([9]), np.array([[0.01, 0.05]]), np.array([100.0, 40.0]))[0]
    pmf = np.array([1.0])
    for p, m in ((0.01, 100), (0.05, 40)):
        for _ in range(m):
            pmf = np.convolve(pmf, [1 - p, p])
    assert abs(mixed + math.log10(pmf[9:].sum())) < 0.05
    y = cooccurrence.fit_null([2, 3], [3, 2], [1, 2], [4, 4])
    assert np.allclose((cooccurrence.fugacity([2, 3], y, np.array([4.0, 4.0]))[:, None] * y / (1 + cooccurrence.fugacity([2, 3], y, np.array([4.0, 4.0]))[:, None] * y)) @ [4, 4], [2, 3], rtol=1e-4)


def test_frequent(spark):
    rng = random.Random(2)
    values = ["hot"] * 3000 + [f"v{rng.randrange(3000)}" for _ in range(6000)] + [""] * 500 + [None] * 50 + ["warm"] * 100
    rng.shuffle(values)
    df = spark.createDataFrame([(v, v) for v in values], "a string, b string").withColumn("n", F.lit(1)).repartition(5)
    found = {(r["field"], r["value"]): (r["n"], r["rows"]) for r in frequent.frequent_from_share(df, ["a", "b"], 5, 7).collect()}
    assert found == {(f, v): (n, 9600) for f in "ab" for v, n in (("hot", 3000), ("", 500), ("warm", 100))}
    assert frequent.most_frequent(df.limit(0), ["a"], 3).count() == 0


def test_top_n(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["g", "g", "h", None]), f"i{k}", rng.choice([None, 0, 1, 5, 5, 900, -3])) for k in range(500)] + [("one", None, 1)]
    df = spark.createDataFrame(rows, "grp string, item string, s bigint").withColumn("rank", F.lit(0))
    got = {}
    for r in topn.top_n_per_group(df, "grp", "item", "s", 5).collect():
        got.setdefault(r["group"], []).append((r["rank"], r["item"]))
    for g in ("g", "h", None, "one"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[2] if r[2] is not None else -(10**9)), r[1] or ""))[:5]
        assert [i for _, i in sorted(got[g])] == [r[1] for r in mine]
    assert topn.top_n_per_group(df.limit(0), "grp", "item", "s", 5).count() == 0


def test_bpe_against_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    rng = random.Random(6)
    texts = ["", "a", "Hello  world's  \n\n x", "<|endoftext|>", "Привет, мир! 123", "a" * 3000, "ab" * 700, "é" * 500, "👩‍👩‍👧 ok", "".join(rng.choice("abcdef '\n") for _ in range(4000)),
             "a" * 200_001, "".join(rng.choice("abcdefgh") for _ in range(30_000)), "!?" * 3001, " " * 7777 + "x", "\n" * 5000]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "ids bigint, text string")
    got = {r["ids"]: (r["x"], r["n"]) for r in df.select("ids", bpe.token_ids(spark, df["text"]).alias("x"), bpe.token_count(spark, df["text"]).alias("n")).collect()}
    for i, x in enumerate(texts):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids, len(got[i][0]))
    assert got[len(texts)] == ([], 0)


def test_merges_file(tmp_path):
    vocab = {c: i for i, c in enumerate([chr(b) for b in range(33, 127)] + [chr(b) for b in [*range(161, 173), *range(174, 256)]] + [chr(256 + k) for k in range(68)])}
    vocab["ab"] = len(vocab)
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": ["a b"]}}))
    m = bpe.load_merges(str(path))
    flat, offsets = bpe.Encoder(m["bytes"], m["merges"]).encode(["abab", None])
    assert flat.tolist() == [vocab["ab"]] * 2 and offsets.tolist() == [0, 2, 2]


def test_packing(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, None, 5, 40, 99, 100, 101, 250, rng.randrange(1, 100)])) for i in range(900)] + [(1, 5), (1, 5), (None, 7), (None, 7), (None, None)]
    df = spark.createDataFrame(rows, "doc bigint, n bigint").withColumn("lane", F.lit(3))
    for lanes in ((1,), (64, 8, 1), (512, 1)):
        got = packing.pack(df, "doc", "n", 100, lanes).collect()
        fill = {}
        for r in got:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["size"]
            assert r["start"] == r["piece"] * 100 and (r["piece"] == 0 or r["start"] > 0)
        total = sum(max(n or 0, 0) for _, n in rows)
        assert max(fill.values()) <= 100 and sum(fill.values()) == total
        assert sum(r["piece"] == 0 for r in got) == len(rows)
        assert sum(r["item"] is None for r in got) == 3
        assert len(fill) <= 1.03 * total / 100 + 1
        again = packing.pack(df.repartition(7), "doc", "n", 100, lanes).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
    assert packing.pack(df.limit(0), "doc", "n", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "doc", "n", 100, (10, 3))


@pytest.mark.parametrize("lanes", [(8, 1), packing.LANES])
def test_containers_of_documents_are_full(spark, lanes):
    """The documents of sf0.1 fill containers of 2,048 tokens to 99 % at least, over many lanes."""
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sized = documents.select("doc_id", bpe.token_count(spark, documents["text"]).alias("n"))
    got = packing.pack(sized, "doc_id", "n", 2048, lanes).groupBy("container_id").agg(F.sum("size").alias("fill"))
    n, tokens, most = got.agg(F.count("*"), F.sum("fill"), F.max("fill")).first()
    assert most <= 2048 and tokens >= 0.99 * 2048 * n


def test_languages(spark):
    samples = spark.createDataFrame(
        [("en", "the old ferry carries letters across the lake with great patience"), ("de", "die alte Fähre bringt Briefe über den See mit großer Geduld"), (None, "x"), ("fr", None)],
        "lang string, text string",
    )
    model = langid.train(samples)
    text = "\n".join(["menu", "the old ferry carries the letters across the lake with the great patience", "short", "die alte Fähre bringt die Briefe über den See mit großer Geduld den die"])
    mojibake = "die alte Fähre bringt die Briefe über den See mit großer Geduld den".encode().decode("cp1252")
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "123 456"), (5, mojibake)], "doc bigint, text string")
    got = {r["doc"]: r["l"] for r in df.select("doc", langid.language_labels(spark, df["text"], model).alias("l")).collect()}
    assert [(s["lang"], s["first_line"], s["last_line"]) for s in got[1]["segments"]] == [("en", 0, 2), ("de", 3, 3)]
    assert sorted(got[1]["line_langs"]) == ["de", "en"]
    assert got[2] is None and got[3] is None and got[4] is None and got[5]["lang"] == "de"
    labels = spark.createDataFrame([("EN_gb",), ("ger",), ("xx",), (" en",), (None,), ("pt-BR",), ("english",)], "l string")
    assert [r[0] for r in labels.select(langid.named_language(F.col("l"))).collect()] == ["en", "de", None, None, None, "pt", None]


EN = ["the old ferry carries letters across the lake", "with great patience the letters cross the lake"]
DE = ["die alte Fähre bringt Briefe über den See", "mit großer Geduld bringt die Fähre alte Briefe"]


def segments(labeller, text):
    (label,) = langid.label_texts(labeller, [text]).to_pylist()
    return [(s["lang"], s["first_line"], s["last_line"], s["longest_line"]) for s in label["segments"]]


def test_short_lines_make_segments():
    en, de = EN, DE
    labeller = langid.Labeller(langid.Model([("en", " ".join(en)), ("de", " ".join(de))]))
    assert segments(labeller, "\n".join(en + de)) == [("en", 0, 1, 8), ("de", 2, 3, 8)]
    long = " ".join(en)
    assert segments(labeller, "\n".join([long, de[0], long])) == [("en", 0, 0, 16), ("de", 1, 1, 8), ("en", 2, 2, 16)]
    # a line without letters decides nothing
    assert segments(labeller, "\n".join([long, "123", "", long])) == [("en", 0, 3, 16)]
    assert segments(labeller, "\n".join([long, *"alte Briefe Fähre Geduld See".split(), long])) == [("en", 0, 0, 16), ("de", 1, 5, 1), ("en", 6, 6, 16)]


def test_switch_within_a_line_and_unknown_text():
    labeller = langid.Labeller(langid.Model([("en", " ".join(EN)), ("de", " ".join(DE))]))
    (label,) = langid.label_texts(labeller, [f"{EN[0]} {DE[0]} {DE[1]} {EN[1]}"]).to_pylist()
    assert [(s["lang"], s["first_word"], s["words"]) for s in label["segments"]] == [("en", 0, 8), ("de", 8, 16), ("en", 24, 8)]
    (other,) = langid.label_texts(labeller, ["όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα τους"]).to_pylist()
    assert other["lang"] == "und" and other["line_langs"] == [] and [s["lang"] for s in other["segments"]] == ["und"]
    nothing = langid.label_texts(labeller, [None, "", "12 34", "\n\n"])
    assert nothing.null_count == 4
    many = langid.label_texts(labeller, [EN[0], None, DE[0]] * 50).to_pylist()
    assert [m and m["lang"] for m in many] == ["en", None, "de"] * 50


def samples_of_languages():
    import pyarrow.parquet as pq

    return [(r["lang"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/lang_samples.parquet").to_pylist()]


def test_planted_mixed_texts_and_confidence():
    """Held-out samples mixed by lines and within lines: words come out in their language, and confidence is what it says."""
    rows, rng = samples_of_languages(), random.Random(4)
    right = total = 0
    sure, truth = [], []
    for fold in range(4):
        labeller = langid.Labeller(langid.Model([r for i, r in enumerate(rows) if i % 4 != fold]))
        held = [(lang, " ".join(langid._WORDS(t))) for lang, t in rows[fold::4]]
        for _ in range(100):
            (a, x), (b, y), (c, z) = rng.sample(held, 3)
            text = f"{x} {y}\n{z}"
            want = [a] * len(x.split()) + [b] * len(y.split()) + [c] * len(z.split())
            (label,) = langid.label_texts(labeller, [text]).to_pylist()
            got = [s["lang"] for s in label["segments"] for _ in range(s["words"])]
            assert len(got) == len(want)
            right += sum(g == w for g, w in zip(got, want))
            total += len(want)
        for lang, t in held:
            words = t.split()
            for k in range(0, len(words) - 1, 2):
                (label,) = langid.label_texts(labeller, [" ".join(words[k : k + 2])]).to_pylist()
                sure.append(label["confidence"])
                truth.append(label["lang"] == lang)
    print(f"words of mixed texts right {right / total:.4f}; pairs of words right {np.mean(truth):.4f}, mean confidence {np.mean(sure):.4f}")
    assert right >= 0.97 * total
    assert abs(np.mean(truth) - np.mean(sure)) < 0.03


def test_bounded_training_keeps_every_language(spark):
    rows = [(lang, f"{lang} {word} {k:02}") for lang, word in (("de", "alte"), ("en", "old"), ("ru", "старый")) for k in range(20)] + [("pt", "velho")]
    samples = spark.createDataFrame(rows, "lang string, text string")
    assert langid.train(samples, most=10).langs == ["de", "en", "pt", "ru"]
    held = langid.train(samples, most=10).index[0]
    assert all(w in held for w in ("alte", "old", "velho", "старый"))
    every, same = langid.train(samples), langid.Model(rows)
    assert every.langs == same.langs and all(np.array_equal(every.scores[0][i], same.scores[0][same.index[0][w]]) for w, i in every.index[0].items())
