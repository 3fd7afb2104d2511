import random

import pytest

from readweave.functions.alignment import KINDS, Scorer, aligned_regions, edits, edits_text, regions_of_path, semiglobal, variants
from readweave.functions.flanks import pattern_regions
from readweave.operators.filters import alignment_threshold
from readweave.errors import OptionError, SpecError
from readweave.operators.spec import Flanks, LibrarySpec

DIFFS = [
    ("ACGT", "TCGT", "1T>A"), ("TATT", "AAGT", "1A>T;3G>T"), ("ACGT", "CGT", "0_1_insA"), ("ACGT", "ACG", "3_4_insT"),
    ("ACGT", "AT", "1_2_insCG"), ("ACGT", "TACGT", "0_0_delT"), ("ACGT", "ACGTTAGG", "4_7_delTAGG"), ("ACGTAGT", "ACGTTAGT", "3_3_delT"),
    ("TCGTTGGCCTAG", "TACGTTGGCCTGGAG", "1_1_delA;11_12_delGG"), ("ACGTA", "TCGT", "1T>A;4_5_insA"), ("A", "AAAAA", "0_3_delAAAA"),
    ("ACGTGCGCGACTAGAGTCCCTAG", "ACGCAATGCGCGACTAGCCCTAG", "3_5_delCAA;17_18_insAGT"), ("ACNGT", "ACXGT", "3X>N"), ("ACGT", "ACGT", ""),
]


@pytest.mark.parametrize("observed,expected,text", DIFFS)
def test_edits(observed, expected, text):
    assert edits_text(edits(observed, expected)) == text


@pytest.mark.parametrize(
    "observed,expected,terminal,text",
    [("CGT", "ACGT", "leading", ""), ("CGT", "ACGT", "trailing", "0_0_delA"), ("ACG", "ACGT", "trailing", ""), ("CGCG", "ACGCGT", "both", ""), ("GCGCTT", "AGCGCGT", "both", "6G>T")],
)
def test_terminal_deletions(observed, expected, terminal, text):
    assert edits_text(edits(observed, expected, terminal)) == text


def test_fragments():
    assert variants("ACG/TAC", "missing_center", "ACGGGTAC", 0) == ""
    assert variants("ATG/TTC", "missing_center", "ACGGGTAC", 2) == "2C>T;7A>T"


def test_path_to_regions():
    assert regions_of_path([(i, i, "M") for i in range(1, 6)], [(1, 5)]) == [(1, 5, "complete")]
    assert regions_of_path([(i, i + 2, "M") for i in range(1, 5)], [(2, 5)]) == [(1, 3, "partial_5")]
    assert regions_of_path([(1, 1, "D"), (1, 2, "D"), (1, 3, "M"), (2, 4, "M")], [(1, 3)]) == [None]
    assert regions_of_path([], [(1, 3)]) == [None]


def test_scores_and_threshold():
    template = "GGCCNNNNNTTTAAGAGAATTTNNNNNCCGG"
    (score, path), (whole, _) = semiglobal(["GGCCNNNNNTTTAAGAGAATTTNN", "GGCCGAAAGTTTAAGAGAATTTCTTTGCCGG"], template, Scorer())
    assert (score, whole) == (88, 106)
    assert alignment_threshold(score, 0.8) == 70
    assert len(path) == 24


FLANKS = [Flanks(None, "AATT"), Flanks("CCGG", "GGCC"), Flanks("TATA", "ATAT"), Flanks("CGCG", None)]


@pytest.mark.parametrize(
    "seq,tolerance,expected",
    [
        ("CCCCAATTGGGCCGGAAAAGGCCGGTATAGGGGATATGGGCGCGTTTT", 0, ["CCCC5", "AAAAc", "GGGGc", "TTTT3"]),
        ("CCCCAATCTAGGCGGAAAAGGCCGGTATAGGGGATATAAACGTTTTTT", 1, ["CCCC5", "AAAAc", "GGGGc", None]),
        ("GGGACCGGAAAAGGCCGGTATAGGGG", 0, [None, "AAAAc", "GGGG3", None]),
        ("GGGGAATTGGGGGGGGCGCG", 0, ["GGGG5", None, None, None]),
        ("AAAAGGCCGGTATAGGGGATATCGCGTTTT", 0, [None, "AAAA5", "GGGGc", "TTTT3"]),
    ],
)
def test_flanks(seq, tolerance, expected):
    (found,) = pattern_regions([seq], FLANKS, tolerance)
    mark = {"partial_5": "5", "complete": "c", "partial_3": "3"}
    assert [f and seq[f[0] : f[1]] + mark[f[2]] for f in found] == expected
    assert pattern_regions([None, ""], FLANKS, 0) == [[None] * 4] * 2


def plain_alignment(read, template, s):
    """Score and path of one read by three plain tables; from the end, diagonal steps before insertions before deletions."""
    low, n, m = -(10**9), len(read), len(template)
    best = [[0] * (m + 1)] + [[low] * (m + 1) for _ in range(n)]
    ins, dele = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(2))

    def pair(i, j):
        a, b = read[i - 1], template[j - 1]
        return s.n_match if "N" in (a, b) else s.match if a == b else s.mismatch

    for i in range(1, n + 1):
        for j in range(m + 1):
            ins[i][j] = max(best[i - 1][j] + s.gap_open, ins[i - 1][j]) + s.gap_extend
            if j:
                dele[i][j] = max(best[i][j - 1] + s.gap_open, dele[i][j - 1]) + s.gap_extend
            best[i][j] = max(ins[i][j], dele[i][j], best[i - 1][j - 1] + pair(i, j) if j else low)
    j = best[n].index(max(best[n]))
    score, i, state, path = best[n][j], n, "M", []
    while i:
        if state == "M":
            if j and best[i][j] == best[i - 1][j - 1] + pair(i, j):
                path.append((i, j, "M" if read[i - 1] == template[j - 1] else "S"))
                i, j = i - 1, j - 1
                continue
            state = "I" if best[i][j] == ins[i][j] else "D"
        path.append((i, j, state))
        if state == "I":
            state, i = ("I" if ins[i][j] == ins[i - 1][j] + s.gap_extend else "M"), i - 1
        else:
            state, j = ("D" if dele[i][j] == dele[i][j - 1] + s.gap_extend else "M"), j - 1
    return score, path[::-1]


def test_batches_against_plain_alignment():
    """Scores, paths and regions of reads with edits, ends cut off and chance reads, whatever batch they are in."""
    rng = random.Random(2)
    template = "TTCGCGCANNNNNNNNNNGGATCTAGGACNNNNNNCAGTGACT"
    regions = [(9, 19), (30, 36)]
    reads = ["", "A", "N", "GGGGGGGGGGGG"]
    for _ in range(150):
        base = [rng.choice("ACGT") if c == "N" else c for c in template]
        for _ in range(rng.randrange(5)):
            at, kind = rng.randrange(len(base)), rng.random()
            if kind < 0.5:
                base[at] = rng.choice("ACGT")
            elif kind < 0.75:
                del base[at]
            else:
                base.insert(at, rng.choice("ACGT"))
        text = "".join(base)
        low, high = rng.choice([0, 0, rng.randrange(20)]), rng.choice([len(text), rng.randrange(20, len(text))])
        reads.append(text[low:high])
    scores, starts, stops, kinds = aligned_regions(reads, template, Scorer(), regions, block=16)
    for k, (read, (score, path)) in enumerate(zip(reads, semiglobal(reads, template, Scorer(), block=64))):
        if not read:
            assert score == 0 and path == [] and (kinds[k] == -1).all()
            continue
        assert (score, path) == plain_alignment(read, template, Scorer()), read
        found = [None if kinds[k, r] < 0 else (starts[k, r], stops[k, r], KINDS[kinds[k, r]]) for r in range(2)]
        assert scores[k] == score and found == regions_of_path(path, regions), read


def construct(*regions):
    """A construct of F for fixed and V for variable regions."""
    made = [{"id": f"r{i}", "seq_type": "Fixed", "seq": "ACGTTGCA"[: 3 + i]} if k == "F" else {"id": f"r{i}", "seq_type": "Library", "min_length": 4, "max_length": 6} for i, k in enumerate(regions)]
    return LibrarySpec.from_dict({"id": "c", "forward_start_region": "r0", "forward_read_length": 20, "reverse_start_region": f"r{len(made) - 1}", "reverse_read_length": 20, "regions": made})


def test_flanks_of_constructs():
    spec = construct("F", "F", "V", "F", "V")
    assert spec.all_flanks(5) == [Flanks("GACGT", "ACGTT"), Flanks("CGTTG", None)]
    assert spec.expected_reverse()[:4] == "NNNN" and len(spec.expected_forward()) == 20
    with pytest.raises(SpecError, match="no fixed flank"):
        construct("V").all_flanks(5)
    with pytest.raises(SpecError, match="adjacent"):
        construct("F", "V", "V", "F")


@pytest.mark.parametrize("tolerance", [-0.1, 1.5])
def test_tolerance_has_bounds(tolerance):
    assert alignment_threshold(100, 0.5) == 50 and alignment_threshold(88, 0.8) == 70
    with pytest.raises(OptionError):
        alignment_threshold(100, tolerance)
