"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeats and odd columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relmill.llm import jaccard_join, line_dedup, mixing, packing, repeats, toxicity
from relmill.llm.embedding_dedup import embedding_dedup
from relmill.llm.exact_dedup import exact_dedup
from relmill.llm.interpolated_lm import interpolated_lm
from relmill.llm.url_filter import url_filter

WORDS = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, id string, size int, n int, grp int, _row int, _text string, score string"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(s or ""))


def fixture_texts():
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base = [say(60) for _ in range(12)]
    near = [" ".join(w if r.random() > 0.02 else "edit" for w in base[0].split()) for _ in range(30)]  # one hot group of near copies
    passage = say(120)
    long = say(4000)
    odd = [None, "", " \n\t ", "one", "one two", "One TWO", "a b c d", "a b c d e", "é ü x ñ\x0b" * 3, "x" * 1000, "ab" * 600, "<|endoftext|> don't <|ENDOFTEXT|>"]
    lines = ["the same line is here again and again " + say(1), "the same line is here again and again"]
    return base + base[:3] + near + [f"{say(30)}\n{passage}\n{say(20)}" for _ in range(6)] + [long, long + " tail"] + odd + [f"{say(20)}\n{lines[i % 2]}\n{say(20)}" for i in range(8)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or ""), "r", 1, "i", 2, 3, 4, 5, "t", "s") for i, t in enumerate(fixture_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(fixture_texts()))


def empty(docs):
    return docs.limit(0)


def repeated(docs):
    return docs.where("doc_id < 5").unionByName(docs.where("doc_id < 5"))


def components(ids, links):
    at = {i: i for i in ids}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return {i: find(i) for i in ids}


def test_exact_dedup(docs, texts):
    got = {r.doc_id: r for r in exact_dedup(docs).collect()}
    same = {}
    for i, t in texts.items():
        same.setdefault(t or "", []).append(i)
    for g in same.values():
        for i in g:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(g), len(g), i == max(g))
    assert len(got) == len(texts) and exact_dedup(empty(docs)).count() == 0
    assert exact_dedup(repeated(docs)).count() == 10
    none = docs.where("doc_id < 2").withColumn("doc_id", F.lit(None).cast("long"))
    assert exact_dedup(none).count() == 2


@pytest.mark.parametrize("most", [400, 2])
def test_repeats(docs, texts, most):
    length = 400
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[s : s + length] for b in data.values() for s in range(len(b) - length + 1))
    for r in repeats.remove_repeats(docs, length, most_contexts=most).collect():
        b = data[r.doc_id]
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        assert bytes(r.kept) == np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert r.n_removed == gone.sum() and r.n_spans == len(r.spans) == (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()
    assert repeats.remove_repeats(empty(docs)).count() == 0
    assert repeats.remove_repeats(repeated(docs)).count() == 10


def test_interval_tree_holds_all_occurrences():
    found = repeats.maximal_repeats([b"xabcdefghij1", b"yabcdefghij2", b"zabcdefghQQQ", b"nothing here"], 8)
    roots = [f for f in found if f[1] == -1]
    assert [(f[0]) for f in roots] == [8] and {o for f in found for o in f[2]} == {(0, 1), (1, 1), (2, 1)}
    assert max(f[0] for f in found) == 10
    assert repeats.maximal_repeats([b"abcdefgh"], 8) == []


def test_jaccard(docs, texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    for heavy in (200, 4):
        got = {r.doc_id: r for r in jaccard_join.jaccard_groups(docs, heavy=heavy).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    assert jaccard_join.jaccard_groups(empty(docs)).count() == 0
    assert jaccard_join.jaccard_groups(repeated(docs)).count() == 10
    assert jaccard_join.choose_boundary({}, 1.0, 75) == 0


def test_line_dedup(docs, texts, spark):
    gone = {r.doc_id: r.lines for r in line_dedup.removed_lines(docs).collect()}
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert len(out) == len(texts) and line_dedup.line_dedup(docs).columns == docs.columns
    for i, t in texts.items():
        want = t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert out[i].text == want
    # every equal judged line stays exactly once, in its first place
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    first = {}
    for i, t in sorted(texts.items()):
        for k, x in enumerate((t or "").split("\n")):
            if len(norm(x).split(" ")) >= 5:
                first.setdefault(norm(x), (i, k))
                if first[norm(x)] != (i, k):
                    assert k in gone[i]
            else:
                assert k not in gone.get(i, [])
    assert line_dedup.removed_lines(empty(docs)).count() == 0
    fuzzy = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambdas"), (3, "quite another line of words that has nothing in common")], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.removed_lines(fuzzy, blocks=8, most_bits=24).collect()} == {2}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_finds_fuzzy_lines(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 9)))
    rows, pairs = [], []
    for n, replaced in [(5, 1), (8, 1), (12, 1), (20, 3), (20, 4)] * 20:
        a = [word() for _ in range(n)]
        b = list(a)
        for i in r.sample(range(n), replaced):
            b[i] = word()
        a, b = " ".join(a), " ".join(b)
        if edit_distance(a, b) <= int(max(len(a), len(b)) * 0.25):
            pairs.append(len(rows) + 1)
        rows += [(len(rows), a), (len(rows) + 1, b)]
    gone = {x.doc_id for x in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone <= set(pairs) and len(pairs) > 60  # nothing but true pairs
    assert len(gone) >= 0.95 * len(pairs)


def test_line_dedup_judges_short_long_and_unspaced_lines(spark, tmp_path):
    from relmill.llm import queries

    r = random.Random(7)
    many = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(700)]
    shuffled = r.sample(many, len(many))
    assert len(" ".join(many)) > 4000 and edit_distance(many, shuffled) > 600
    chinese = "今天的天气非常好我们一起去公园散步吧然后回家吃晚饭"
    rows = [
        (1, "Share on X\n\nPage 12"), (2, "share on x!\n\npage 13"),  # equal but for signs; blank lines and near ones stay
        (3, chinese), (4, chinese), (5, chinese.replace("公园", "海边")),
        (6, " ".join(many)), (7, " ".join(shuffled)), (8, " ".join([*many[:-3], "other", "words", "here"])),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op7_line_dedup(spark, str(tmp_path)).where("n_removed > 0").collect()
    assert {x.doc_id: x.removed_lines for x in out} == {2: [0], 4: [0], 5: [0], 8: [0]}


def test_mixing(docs, spark):
    weights = {"src0": 5.0, "src1": 2.0, "src2": 3.0}
    out = mixing.mix(docs, weights, block_rows=2)
    assert out.count() == docs.count() and set(out.columns) > set(docs.columns)
    rows = [r for r in out.collect() if r._release is not None]
    assert all(r._release <= r._slot < r._deadline for r in rows)
    assert mixing.mix(empty(docs), weights).count() == 0 and mixing.mix(repeated(docs), {}).count() == 10
    assert [r.doc_id for r in mixing.in_order(docs, weights, block_rows=2).collect()] == [r.doc_id for r in sorted(out.collect(), key=lambda r: (r._slot, r._place))]


def test_pfair_deviation_stays_under_one_block():
    blocks, weights = {"a": 300, "b": 90, "c": 400, "d": 7}, {"a": 0.5, "b": 0.21, "c": 0.28, "d": 0.01}
    plan = mixing.pfair(blocks, weights)
    assert len(plan) == sum(blocks.values()) and all(r <= t < d for t, (_, _, r, d, _) in enumerate(plan))
    begin, done, phase = 0, Counter(), 0
    for t, (s, _, _, _, p) in enumerate(plan):
        if p != phase:
            begin, done, phase = t, Counter(), p
        left = {x: weights[x] for x in blocks if sum(1 for q in plan[:begin] if q[0] == x) < blocks[x]} if t == begin else left
        done[s] += 1
        for x in left:
            assert abs(left[x] / sum(left.values()) * (t + 1 - begin) - done[x]) < 1 + 1e-4


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    length = 256
    rows = packing.pack(docs, path, length, with_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in texts.items():
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == want and all(len(r.ids) == r.length and r.start == k * length for k, r in enumerate(own))
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
        assert all(r.length == length for r in own[:-1])
    full = {}
    for r in rows:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in full.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= length
    assert packing.pack(empty(docs), path).count() == 0


def test_reduction_keeps_an_optimal_packing():
    r = random.Random(5)

    def least(items, cap):
        best = [len(items)]

        def put(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap:
                    put(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            put(i + 1, [*bins, items[i]])

        put(0, [])
        return best[0]

    for _ in range(60):
        cap = r.randint(6, 20)
        items = sorted((r.randint(1, cap) for _ in range(r.randint(1, 8))), reverse=True)
        counts = np.bincount(items, minlength=cap + 1).astype(np.int64)
        fixed = packing.reduce_counts(counts, cap)
        rest = [s for s in range(cap, 0, -1) for _ in range(counts[s])]
        assert sum(m for _, _, m in fixed) + least(rest, cap) == least(items, cap)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=64)
    rows = [(i, [float(x) for x in rng.normal(size=64)], i % 3) for i in range(200)]
    rows += [(200 + i, [float(x) for x in hot + 0.02 * rng.normal(size=64)], 1) for i in range(150)]
    rows += [(400 + i, [float(x) for x in hot * (i + 1)], 1 if i < 3 else None) for i in range(4)]
    rows += [(500, None, 1), (501, [0.0] * 64, 1), (502, [float("nan")] * 64, 1), (503, [None] * 64, 1), (504, [], 1), (505, [1.0, 2.0], 1), (506, rows[3][1], 0), (507, rows[3][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("x"))
    ok = [(i, np.array(v, float), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[k + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and cos(a[1], b[1]) >= 0.93]
    n = Counter(x for e in links for x in e)
    comp = components([r[0] for r in rows], links)
    for options in ({}, {"per_cell": 20, "block": 16}):
        got = {r.vec_id: r for r in embedding_dedup(df, **options).collect()}
        assert len(got) == len(rows)
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], comp[i], comp[i] == i) for i in got}
    assert embedding_dedup(df.limit(0)).count() == 0


def test_toxicity(spark, docs):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join([r.choice(WORDS) for _ in range(40)] + (["awful"] if bad else []))))
        labels.append((i, 0, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(d, y).collect()
    held = [x for x in out if x.held_out]
    assert len(out) == 600 and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in out)
    assert sum(x.predicted == (x.doc_id % 4 == 0) for x in held) / len(held) > 0.97
    slots, _ = toxicity.train(d, y)
    assert len(slots) < 20_000  # sparse: of all the features seen, few have a weight
    none = toxicity.toxicity(docs, y.limit(0)).collect()
    assert len(none) == docs.count() and all(x.score == 0.0 and x.predicted == 0 for x in none)
    assert toxicity.toxicity(empty(docs), y).count() == 0 and toxicity.toxicity(repeated(docs), y).count() == 10


def test_language_model(docs, texts):
    out = {r.doc_id: r for r in interpolated_lm(docs, chunk_bytes=4096).collect()}
    learn = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i in texts}
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    c = Counter(x for i, t in tokens.items() if learn[i] for x in t)
    total = sum(c.values())
    for i, t in tokens.items():
        r = out[i]
        base = sum(np.log10((c[x] + 0.1) / (total + 0.1 * (len(c) + 1))) for x in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learn[i], len(t), sum(c[x] > 0 for x in t), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    held = [r for r in out.values() if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert interpolated_lm(empty(docs)).count() == 0 and interpolated_lm(repeated(docs)).count() == 10


def test_url_filter(spark):
    link = lambda u: f'<html><!-- <link rel="canonical" href="http://bad.net/es/x"> --><link href="{u}" rel="canonical"></html>'
    rows = [
        (1, "http://bad.net/es/x", None), (2, "http://www.alias.org/a#frag", link("http://BAD.net/es/x")), (3, "https://shop.com/es/", link("http://bad.net/es/x")), (4, "http://far.org/z", link("http://www.alias.org/a")),
        (5, "http://example.com/en/1", None), (6, "http://www.example.com/en/1", None), (7, None, None), (8, "no scheme", "<p>"), (9, "http://lone.org?x=/es/", '<meta http-equiv="refresh" content="0; url=/next">'), (10, "http://lone.org/rel/a", link("b")), (10, "http://lone.org/rel/a", link("b")),
    ]
    from relmill.llm.queries import URL_RULES

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1)).withColumn("node", F.lit(1))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, URL_RULES).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "bad.net", "/es/x", "net/es/", "block"), (2, "www.alias.org", "/a", None, "block"), (3, "shop.com", "/es/", "com/", "allow"), (4, "far.org", "/z", None, "block"), (5, "example.com", "/en/1", "example.com/en/", "block"),
        (6, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "lone.org", "", None, "allow"), (10, "lone.org", "/rel/a", None, "allow"), (10, "lone.org", "/rel/a", None, "allow"),
    ], key=str)
    more = spark.createDataFrame([("http://lone.org/rel/a", "http://bad.net/fr/1")], "src string, dst string")
    assert {r.verdict for r in url_filter(pages.where("page_id = 10"), URL_RULES, more).collect()} == {"block"}
    assert url_filter(pages.limit(0), URL_RULES).count() == 0


def test_exact_sql(spark, duck):
    from relmill.llm import queries

    for name, sql in queries.SQL.items():
        a, b = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), duck.sql(sql).df()
        cols = sorted(a.columns)
        assert sorted(map(str, a[cols].to_numpy().tolist())) == sorted(map(str, b[cols].to_numpy().tolist()))


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline as cp

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    for i, (_, stage) in enumerate(cp.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        assert now.columns == docs.columns
    kept = now.count()
    pieces = cp.run(spark, str(tmp_path))
    assert pieces.select("doc_id").distinct().count() == kept < docs.count()


def test_packing_stage_follows_the_weights(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp

    r = random.Random(9)
    rows = [(i, f"src{i % 2}", " ".join(r.choice(WORDS) for _ in range(2500))) for i in range(256)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    source = {i: s for i, s, _ in rows}
    monkeypatch.setattr(cp, "STAGES", cp.STAGES[3:])  # the trained stages take no part in the order

    def early(weights):
        monkeypatch.setattr(cp, "SOURCE_WEIGHTS", weights)
        out = cp.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "sequence_id", "offset").collect()
        used = sorted((x.sequence_id, x.offset, x.length) for x in out)
        assert {x[0] for x in used} == set(range(len({x[0] for x in used}))) and len(set(used)) == len(used)
        full = [source[x.doc_id] for x in sorted(out, key=lambda x: x.sequence_id) if x.length == 2048]
        return Counter(full[: len(full) // 2])["src0"] / (len(full) // 2)

    assert early({"src0": 3.0, "src1": 1.0}) > 0.7 and early({"src0": 1.0, "src1": 3.0}) < 0.3
