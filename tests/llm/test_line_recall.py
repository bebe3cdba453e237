"""Line dedup at its registered setting: recall against brute force, and its edit distance."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from relmill.llm import line_dedup as L
from relmill.llm.common import Scratch


def codes(s):
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def similar(a, b):
    longer = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)])
    return L.edit_distances([codes(x) for x in a], [codes(x) for x in b]) <= np.floor(longer * 0.25 + 1e-9)


def similar_pairs(lines):
    """All pairs with an edit similarity of at least 0.75; letters that only one line holds rule most of them out."""
    held = np.zeros((len(lines), 256), np.int32)
    for i, x in enumerate(lines):
        np.add.at(held[i], [ord(c) & 255 for c in x], 1)
    n, pairs = np.array([len(x) for x in lines]), []
    for i in range(len(lines)):
        d = held[i + 1 :] - held[i]
        least = np.maximum(np.where(d > 0, d, 0).sum(1), np.where(d < 0, -d, 0).sum(1))
        pairs += [(i, int(j)) for j in np.flatnonzero(least <= np.maximum(n[i], n[i + 1 :]) * 0.25) + i + 1]
    keep = similar([lines[i] for i, _ in pairs], [lines[j] for _, j in pairs])
    return [p for p, k in zip(pairs, keep, strict=True) if k]


def classes(spark, lines):
    """The first line of each line's class, by the setting of the registered query."""
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    defaults = L.removed_lines.__defaults__  # id_col, text_col, similarity, min_words, blocks, most_bits, min_chars
    placed, keep = L.line_groups(docs, Scratch(spark), *defaults[:3], 1, *defaults[4:])
    return {r.doc_id: int(r.keep) >> 32 for r in placed.join(keep, ["h1", "h2"]).select("doc_id", "keep").collect()}


@pytest.fixture(scope="module")
def lines(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    norm = L.normalised(pa.array(sorted({x for t in texts for x in t.split("\n")}), pa.large_string())).to_pylist()
    return sorted({x for x in norm if len(x) >= 20 or x.count(" ") >= 4})


def test_recall_of_real_pairs(spark, lines):
    true, got = similar_pairs(lines), classes(spark, lines)
    assert len(true) > 30 and sum(got.get(i) == got.get(j) is not None for i, j in true) >= 0.9 * len(true)
    assert set(got) <= {i for p in true for i in p}  # and nothing else


@pytest.mark.parametrize(("edit", "least"), [("middle", 0.97), ("three", 0.85), ("insert", 0.97), ("delete", 0.97), ("letters", 0.9)])
def test_recall_of_planted_edits(spark, lines, edit, least):
    r = random.Random(5)
    words = [w for x in lines for w in x.split() if len(w) > 2]
    base = [x for x in lines if 8 <= x.count(" ") + 1 <= 25]
    base = r.sample(base, 200)

    def edited(x):
        w = x.split()
        if edit == "middle":
            w[len(w) // 2] = r.choice(words)
        elif edit == "three":
            for i in r.sample(range(len(w)), 3):
                w[i] = r.choice(words)
        elif edit == "insert":
            w.insert(r.randrange(len(w)), r.choice(words))
        elif edit == "delete":
            del w[r.randrange(len(w))]
        else:
            return "".join(r.choice("abcdefgh") if c != " " and r.random() < 0.02 else c for c in x)
        return " ".join(w)

    other = [edited(x) for x in base]
    got, true = classes(spark, base + other), similar(base, other)
    hit = [base[i] == other[i] or got.get(i) == got.get(200 + i) is not None for i in range(200)]
    assert true.sum() > 100 and sum(h for h, t in zip(hit, true, strict=True) if t) >= least * true.sum()


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    r, a, b = random.Random(3), [], []
    for _ in range(150):
        n, k = r.choice([0, 1, 5, 63, 64, 65, 128, 130, 200]), r.choice([2, 5, 30])
        x = [r.randrange(k) for _ in range(n)]
        y = list(x) if r.random() < 0.6 else [r.randrange(k) for _ in range(r.randrange(200))]
        for _ in range(r.randrange(20)):
            i = r.randrange(len(y) + 1)
            y[i : i + r.randrange(2)] = [r.randrange(k)] * r.randrange(2)
        a.append(np.array(x, np.uint32)), b.append(np.array(y, np.uint32))
    assert L.edit_distances(a, b).tolist() == [plain(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]
    assert len(L.edit_distances([], [])) == 0
    long = np.arange(20_000, dtype=np.uint32) % 50
    assert L.edit_distances([long], [np.delete(long, [7, 9000, 19_000])]).tolist() == [3]


def test_very_long_line(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    long = [word() for _ in range(12_000)]
    other = [x if r.random() > 0.05 else word() for x in long]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(r.sample(long, len(long)))), (4, None), (5, ""), (None, " ".join(long))], "doc_id long, text string")
    assert {x.doc_id: x.lines for x in L.removed_lines(docs, min_words=1).collect()} == {2: [0]}


@pytest.mark.parametrize("rows", [1, 7, 400])
def test_check_loses_no_pair(rows):
    """Of candidate pairs exactly those of the stated edit similarity pass, in batches of any size."""
    r = random.Random(1)
    words = ["".join(r.choice("aeioutnshrl") for _ in range(r.randint(2, 9))) for _ in range(300)]
    pairs, want = [], set()
    for i in range(400):
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 20)))
        rate = [0.05, 0.1, 0.2, 0.27][i % 4]
        u = " ".join(r.choice(words) for _ in t.split()) if i % 5 == 0 else "".join(c if r.random() > rate else r.choice("aeiou xyz") for c in t)
        pairs.append((i, -i - 1, t, u))
        if plain(t, u) <= int(max(len(t), len(u)) * 0.25 + 1e-9):
            want.add(i)
    got = set()
    for lo in range(0, len(pairs), rows):
        batch = pa.RecordBatch.from_pydict({name: [p[j] for p in pairs[lo : lo + rows]] for j, name in enumerate(("a", "b", "ta", "tb"))})
        for out in L._similar(0.75)([batch]):
            got |= set(out.column("a").to_pylist())
    assert got == want and 200 < len(want) < 350
