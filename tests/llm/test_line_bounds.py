"""Line dedup's bounded alignment, SimHash votes and normalised lines, against plain forms of the same."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from relmill.llm import line_dedup as L
from relmill.llm.common import sized_hashes


def codes(s):
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def pairs(letters):
    r, out = random.Random(4), []
    for i in range(240):
        x = [r.choice(letters) for _ in range(r.choice([0, 1, 5, 63, 64, 65, 130, 300, 700]))]
        y = [r.choice(letters) for _ in range(len(x) + r.randrange(9))] if i % 4 == 0 else list(x)
        for _ in range(r.choice([0, 1, 3, 20, 90])):
            j = r.randrange(len(y) + 1)
            y[j : j + r.randrange(2)] = [r.choice(letters)] * r.randrange(2)
        out.append(("".join(x), "".join(y)))
    return [codes(x) for x, _ in out], [codes(y) for _, y in out]


@pytest.mark.parametrize("letters", ["ab", "abcdefghij klmnop", "".join(chr(0x4E00 + i) for i in range(400))])
def test_distances_up_to_a_bound(letters):
    """Exact up to the bound and above it beyond, whatever leaves the band or ends early."""
    a, b = pairs(letters)
    exact, longer = L.edit_distances(a, b), np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)])
    for share in (0, 0.1, 0.25, 0.6):
        most = (longer * share).astype(np.int64)
        got = L.edit_distances(a, b, most)
        near = exact <= most
        assert got[near].tolist() == exact[near].tolist() and (got[~near] > most[~near]).all()


def test_strangers_are_not_aligned_to_the_end(monkeypatch):
    """Of long lines that have little in common only a part of the columns is worked on."""
    r, seen, real = random.Random(6), [], L._least_costs
    lines = [codes("".join(r.choice("aeioutnshrl ") for _ in range(2000))) for _ in range(40)]
    monkeypatch.setattr(L, "_least_costs", lambda *x: seen.append(x[6]) or real(*x))
    most = np.full(20, 500)
    assert (L.edit_distances(lines[:20], lines[20:], most) > most).all() and 0 < max(seen) < 1700


def test_votes_of_many_words():
    r = np.random.default_rng(1)
    n = np.array([1, 2, 255, 256, 600, 3, 5000])
    h = r.integers(0, 2**63, int(n.sum()), np.uint64)
    want = [np.packbits(np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(0) * 2 > len(x)).view(np.uint64)[0] for x in np.split(h, np.cumsum(n)[:-1])]
    assert L.simhashes(h, n).tolist() == [int(x) for x in want]


def test_normalised_lines_of_both_kinds():
    lines = pa.array(["", " ", "A  B.", "É—x", "\t", "...", "\x00b", "中文 X", "x\x0by", "a_b-C 9", "  Ünï  "], pa.large_string())
    want = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(lines), r"[^\pL\pN]+", " "))
    assert L.normalised(lines).equals(want) and L.normalised(lines[:0]).to_pylist() == [] and L.normalised(lines[3:4]).to_pylist() == ["é x"]
    assert len(sized_hashes(want)[0]) == sum(len(x.split()) for x in want.to_pylist())


def test_hashes_of_spaced_lines():
    norm = L.line_tokens(pa.array(["a", "some words of a line", "中文字 x", "é " * 40 + "end", "longer than eight bytes"], pa.large_string()))
    for part in (norm, norm[1:3], norm[4:]):
        assert all(np.array_equal(x, y) for x, y in zip(L.spaced_hashes(part), sized_hashes(part), strict=True))


def test_ids_of_any_size(spark):
    """Small ids are placed by whole numbers of 64 bits, larger ones by decimals; the first line stays in both."""
    for ids in ((5, -7, 2**31 - 1), (5, -7, 2**31), (2**62, -(2**62), 0)):
        docs = spark.createDataFrame([(i, f"own {k}\nthe very same line here") for k, i in enumerate(ids)], "doc_id long, text string")
        assert {r.doc_id: r.lines for r in L.removed_lines(docs, min_words=1).collect()} == {i: [1] for i in ids if i != min(ids)}
