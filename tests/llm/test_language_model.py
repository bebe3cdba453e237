"""The interpolated model's score against the same estimates worked out word by word."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relmill.llm.interpolated_lm import interpolated_lm


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def plain_scores(texts, chunk, learnt):
    """texts, chunk number and whether it is learnt from, by id; the score of each."""
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), None] for i, t in texts.items()}
    pairs = lambda w: list(zip(["<begin>", *w[:-1]], w, strict=True))
    kept = {i for i in texts if learnt[i] and chunk[i] % 10}
    count = lambda ids: (Counter(w for i in ids for w in tokens[i]), Counter(p for i in ids for p in pairs(tokens[i])))
    all1, all2 = count([i for i in texts if learnt[i]])
    kept1, kept2 = count(kept)
    types = len(all1)

    def estimates(p, one, two, starts):
        context = starts if p[0] == "<begin>" else one[p[0]]
        bucket = min(39, 1 + int(math.log2(context))) if context else 0
        return bucket, two[p] / max(context, 1), one[p[1]] / max(sum(one.values()), 1), 1 / (types + 1)

    held = [estimates(p, kept1, kept2, len(kept)) for i in texts if learnt[i] and not chunk[i] % 10 for p in pairs(tokens[i])]
    weights = np.full((40, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    for _ in range(12):
        total = np.zeros((40, 3))
        for b, *f in held:
            part = weights[b] * np.array(f)
            total[b] += part / max(part.sum(), 1e-300)
        new = weights.copy()
        seen = total.sum(1) > 0
        new[seen] = total[seen] / total[seen].sum(1, keepdims=True)
        new = np.maximum(new, 1e-9)
        new[0, 0] = 0
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - weights).max() < 1e-4
        weights = new
        if done:
            break
    starts = sum(learnt.values())
    out = {}
    for i in texts:
        rows = [estimates(p, all1, all2, starts) for p in pairs(tokens[i])]
        out[i] = sum(math.log10(float(weights[b] @ np.array(f))) for b, *f in rows)
    return out


def test_score_matches_brute_force(spark):
    r = random.Random(6)
    words = [f"W{int(r.expovariate(0.05))}" for _ in range(400)]
    texts = {i: " ".join(r.choice(words) for _ in range(r.randint(1, 60))) for i in range(150)} | {900: None, 901: "", 902: " \t ", 903: "a " * 5000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    p = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(10)).alias("p"))
    chunk = {x.doc_id: x.p for x in p.collect()}
    learnt = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i in texts}
    got = {x.doc_id: x.score for x in interpolated_lm(docs).collect()}
    want = plain_scores(texts, chunk, learnt)
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-4, abs=1e-4) for i in want)


def test_rows_without_ids_are_dealt_over_chunks(spark):
    r = random.Random(7)
    rows = [(None, " ".join(r.choice("abcdefgh") for _ in range(30))) for _ in range(200)] + [(5, f"{i} x") for i in range(50)]
    out = interpolated_lm(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=300)
    assert out.count() == 250 and out.where("doc_id is null").count() == 200
    assert len({x.train_tokens for x in out.collect()}) == 1
