"""Fuzzy line deduplication.

Lines are normalised (case, signs and white space) and equal ones collapsed. Every distinct line has a SimHash of 64
bits, the majority vote of its telling words' hashes, and ``blocks`` join keys. Blocks of the SimHash's own bits, joined
as pigeonholes, miss most of the lines with an edit similarity near 0.75, because one word in ten moves eight bits of
64 (README has the figures). The votes on a block are therefore sampled: each of ROWS hashes elects the word that it
ranks first, and the block is equal when the elected are. With a share j of common words that has a chance of j^4.
Lines that agree on any block and on enough bits of the SimHash are candidates, and must pass a check of edit
similarity. The first line of each connected group stays, in order of document and line number.

Telling words have four bytes or more: short ones are in most lines and would make strangers look alike. Lines without
any elect among all their words. In lines of scripts without spaces, pairs of characters stand for words.

Most keys belong to one line alone. They travel in messages, one for each batch of lines and bucket of keys, and only
those that two lines share become rows. A key that many lines of a batch share is settled in the batch and sends one
line, so that the bucket of a hot key stays small.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import LOWER, M1, M2, M3, Scratch, linked_groups, mix, raw, sized_hashes, slices, span_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 4
KEY_BITS = 48
FUZZY_WORDS = 5
LETTERS = 1 << 19  # of pairs whose common ends are looked for at once, about
GROUP_WORDS = 4096  # words of 64 rows that edit_distances holds at once, about
ALPHABET = 256  # letters of which every pair has a table of its own
#: ASCII letters in lower case and digits; other ASCII characters are spaces.
PLAIN = np.array([LOWER[i] if i >= 128 or chr(i).isalnum() else 32 for i in range(256)], np.uint8)
#: The eight bits of a byte, each in a byte of its own.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
BUCKET_KEYS = 2_000_000  # keys of a bucket, on average: 32 MB
#: Thai, Lao, Myanmar, Khmer, kana and Han.
UNSPACED = re.compile("([฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿])(?=[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿])")


def normalised(lines: pa.Array) -> pa.Array:
    """Runs of letters and digits, lower-cased, one space between them. ASCII lines are told by their bytes, at half the cost."""
    lines = lines.cast(pa.large_string())
    flags = pc.equal(pc.binary_length(lines), pc.utf8_length(lines)).to_numpy(zero_copy_only=False)
    plain, other = (lines.filter(pa.array(x)) for x in (flags, ~flags))
    data, offsets = raw(plain)
    plain = pa.Array.from_buffers(pa.large_string(), len(plain), [None, pa.py_buffer(offsets), pa.py_buffer(PLAIN[data])])
    out = pa.concat_arrays([pc.replace_substring_regex(plain, "  +", " "), pc.replace_substring_regex(pc.utf8_lower(other), r"[^\pL\pN]+", " ")])
    place = np.where(flags, np.cumsum(flags), flags.sum() + np.cumsum(~flags)) - 1
    return pc.utf8_trim_whitespace(out.take(pa.array(place, pa.int64())))


def line_tokens(norm: pa.Array) -> pa.Array:
    """norm with a space after each character of a script without spaces that another one follows, doubled into pairs."""
    dense = np.flatnonzero(pc.greater_equal(pc.multiply(pc.binary_length(norm), 2), pc.multiply(pc.utf8_length(norm), 3)).to_numpy(zero_copy_only=False))
    if not len(dense):
        return norm
    out = norm.to_pylist()
    for i in dense.tolist():
        s = out[i]
        out[i] = UNSPACED.sub(lambda m: f"{m[1]}{s[m.end()]} ", s)
    return pa.array(out, pa.large_string())


def spaced_hashes(norm: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sized_hashes of normalised lines with a word or more, whose words are told by the single spaces between them."""
    data, offsets = raw(norm)
    low = np.full(len(data) + 8, 32, np.uint8)
    low[: len(data)] = data
    first = np.zeros(len(data) + 1, bool)
    first[1:] = low[: len(data)] == 32
    first[offsets] = True
    starts = np.flatnonzero(first[: len(data)])
    n = np.diff(np.searchsorted(starts, offsets))
    size = np.diff(starts, append=len(data)) - 1
    size[np.cumsum(n) - 1] += 1  # no space follows a line's last word
    return span_hashes(low, starts, size), np.repeat(np.arange(len(n)), n), size


def telling_words(h: np.ndarray, line: np.ndarray, size: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the telling words, or of all words of lines without any, their numbers by line and each line's first place."""
    telling = size >= 4
    use = telling | ~(np.bincount(line[telling], minlength=lines) > 0)[line]
    n = np.bincount(line[use], minlength=lines)
    return h[use], n, np.cumsum(n) - n


def simhashes(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of every line's n hashes the bits that more than half of them have. Eight votes are counted in one number, of 255 hashes at most."""
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    begin = np.repeat(np.cumsum(n) - n, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    votes = np.stack([np.add.reduceat(BITS[x], begin) for x in np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8).T)], axis=1).view(np.uint8)
    if len(votes) > len(n):
        votes = np.add.reduceat(votes, first, axis=0, dtype=np.int32)
    return np.packbits(votes > (n // 2)[:, None], axis=1).view(np.uint64).ravel()


def elected_keys(norm, blocks: int) -> np.ndarray:
    """The ``blocks`` keys of every normalised line, in turn."""
    turns = mix(np.arange(1, ROWS * blocks + 1, dtype=np.uint64) * M2) | np.uint64(1)
    h, _, begin = telling_words(*spaced_hashes(line_tokens(norm)), len(norm))
    keys = np.empty((len(norm), blocks), np.int64)
    for b in range(blocks):
        key = np.full(len(norm), b, np.uint64)
        for turn in turns[b * ROWS : (b + 1) * ROWS]:
            key = mix(key ^ np.minimum.reduceat(h * turn, begin))
        keys[:, b] = (key >> np.uint64(64 - KEY_BITS)).astype(np.int64)
    return keys.ravel()


def _sketch(min_words: int):
    """The judged lines of documents: numbers, two hashes, length, SimHash and the normalised line."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                lists = pc.split_pattern(part.column("text").cast(pa.large_string()).fill_null(""), "\n")
                count = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(count)), count)
                line_no = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                norm = normalised(lists.flatten())
                words = pc.add(pc.count_substring(norm, " "), 1).to_numpy(zero_copy_only=False)
                keep = (pc.binary_length(norm).to_numpy(zero_copy_only=False) > 0) & (words >= min_words)
                norm, row, line_no, words = norm.filter(pa.array(keep)), row[keep], line_no[keep], words[keep]
                if not len(row):
                    continue
                h, line, size = spaced_hashes(line_tokens(norm))
                n = np.bincount(line, minlength=len(row))
                begin = np.cumsum(n) - n
                place = (np.arange(len(h)) - np.repeat(begin, n)).astype(np.uint64)
                h1, h2 = (np.add.reduceat(mix(h + place * m + M3), begin) for m in (M1, M2))
                h, n, _ = telling_words(h, line, size, len(row))
                sig = simhashes(h, n)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(line_no.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(words >= FUZZY_WORDS)]
                    + [pc.utf8_length(norm).cast(pa.int32()), pa.array(sig.view(np.int64)), norm.cast(pa.string())],
                    ["doc_id", "line_no", "h1", "h2", "wordy", "len", "sig", "norm"],
                )

    return run


PAIR = np.dtype([("key", "<i8"), ("rid", "<i8")])


def packed(pairs: np.ndarray) -> bytes:
    """Byte planes apart: the high ones of sorted keys and of neighbouring numbers compress well."""
    return np.ascontiguousarray(pairs).view(np.uint8).reshape(-1, PAIR.itemsize).T.tobytes()


def unpacked(blobs) -> np.ndarray:
    parts = [np.frombuffer(b, np.uint8).reshape(PAIR.itemsize, -1).T.copy().view(PAIR).ravel() for b in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, PAIR)


def _runs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pairs in order of key and rid, whether another one has the same key, and whether it is the first that has."""
    pairs = pairs[np.lexsort((pairs["rid"], pairs["key"]))]
    same = pairs["key"][1:] == pairs["key"][:-1]
    return pairs, np.append(same, False) | np.append(False, same), ~np.append(False, same)


def _messages(buckets: int, blocks: int):
    """Keys of a batch by bucket; those that several of its lines share in bucket -1, and once in their own."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = np.empty(batch.num_rows * blocks, PAIR)
            pairs["key"] = np.concatenate([elected_keys(part.column("norm"), blocks) for part in slices(batch, "norm")])
            pairs["rid"] = np.repeat(batch.column("rid").to_numpy(zero_copy_only=False), blocks)
            pairs, met, first = _runs(pairs)
            out, names = [packed(pairs[met])], [-1]
            pairs = pairs[first]
            bucket = pairs["key"] % buckets
            order = np.argsort(bucket, kind="stable")
            pairs, bucket = pairs[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            out += [packed(x) for x in np.split(pairs, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(names, bucket[cuts]).astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "data"])

    return run


def _open(batches):
    for batch in batches:
        pairs = unpacked(batch.column("data").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(pairs["key"].copy()), pa.array(pairs["rid"].copy())], ["key", "id"])


def _meet(table: pa.Table) -> pa.Table:
    pairs, met, _ = _runs(unpacked(table.column("data").to_pylist()))
    return pa.table({"key": pairs["key"][met], "id": pairs["rid"][met]})


def places(n: np.ndarray) -> np.ndarray:
    """The places 0, 1, ... in each of runs of n."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _trimmed(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> list[np.ndarray]:
    """Codes and lengths of both sides without the ends that the lines of a pair have in common, which cost nothing."""
    out = [a[:0]], [na[:0]], [b[:0]], [nb[:0]]
    ends, cuts = (np.cumsum(na), np.cumsum(nb)), [*np.flatnonzero(np.diff((np.cumsum(na) + np.cumsum(nb)) // LETTERS, prepend=-1)).tolist(), len(na)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        sizes, stops, same = [x[lo:hi] for x in (na, nb)], [x[lo:hi] for x in ends], []
        least = np.minimum(*sizes)
        for last in (False, True):
            pair, at = np.repeat(np.arange(hi - lo), least), places(least)
            x, y = (e[pair] - 1 - at if last else (e - n)[pair] + at for e, n in zip(stops, sizes, strict=True))
            unlike = np.flatnonzero(a[x] != b[y])
            unlike = unlike[np.diff(pair[unlike], prepend=-1) > 0]  # the first of each pair
            same.append(least.copy())
            same[-1][pair[unlike]] = at[unlike]
            least = least - same[-1]
        for i, codes, e, n in zip((0, 2), (a, b), stops, sizes, strict=True):
            left = n - same[0] - same[1]
            out[i].append(codes[np.repeat(e - n + same[0], left) + places(left)])
            out[i + 1].append(left)
    return [np.concatenate(x) for x in out]


def edit_distances(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distances of pairs of code arrays; with ``most`` they are exact up to it, and some number above it beyond."""
    flat = lambda x: (np.concatenate([*x, np.zeros(0, np.uint32)]), np.array([len(i) for i in x], np.int64))
    return flat_distances(*flat(a), *flat(b), most)


def flat_distances(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """As edit_distances, of lines that follow each other in a and b with lengths na and nb."""
    a, na, b, nb = _trimmed(a, na, b, nb)
    out = np.maximum(na, nb)
    k = out if most is None else np.minimum(out, most)
    todo = np.flatnonzero((np.minimum(na, nb) > 0) & (np.abs(na - nb) <= k))
    if not len(todo):
        return out
    codes, alphabet = np.concatenate([a, b]), 1 << 32
    if int(codes.max()) <= sys.maxunicode:
        held = np.zeros(int(codes.max()) + 1, bool)
        held[codes] = True
        codes, alphabet = (np.cumsum(held) - 1)[codes], int(held.sum())
    turned, every = (nb < na).astype(int), np.arange(len(na))  # rows are the shorter line's letters
    sizes, begins = np.stack([na, nb]), np.stack([np.cumsum(na) - na, len(a) + np.cumsum(nb) - nb])
    m, n, at_m, at_n = sizes[turned, every], sizes[1 - turned, every], begins[turned, every], begins[1 - turned, every]
    width, off = (m + 63) >> 6, (k - n + m) // 2
    todo = todo[np.lexsort((n[todo], width[todo]))]
    wide, done = width[todo], 0
    while done < len(todo):
        w, i = int(wide[done]), todo[done]
        held = min(w, int(2 * off[i] + n[i] - m[i]) // 64 + 2)
        some = todo[done : min(done + max(1, min(GROUP_WORDS // held, (1 << 22) // (w * min(64 * w, alphabet)))), int(np.searchsorted(wide, w + w // 2, "right")))]
        done += len(some)
        out[some] = _aligned(codes.astype(np.int64, copy=False), alphabet, at_m[some], m[some], at_n[some], n[some], off[some])
    return out


def _aligned(codes: np.ndarray, alphabet: int, at_m: np.ndarray, m: np.ndarray, at_n: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Edit distances, bit-parallel (Myers, 1999; blocks after Hyyro, 2003), of m letters from at_m on (rows) and n >= m from at_n on.

    The columns' words of 64 rows depend on each other from top to bottom, so the words of all pairs advance together, each
    one column behind the word above it. A path of k edits strays at most ``off`` = (k - n + m) / 2 from the diagonals of both
    corners (Ukkonen, 1985), so a word works only in the columns where a pair's band crosses it. Outside every step costs one,
    which is a path's cost as well: what comes out is never too small, and exact where the band holds the best path. Lines
    of fewer words get a common start that changes nothing. A pair leaves once all that its paths can go on from costs more than k."""
    one, full, p, width = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), len(m), (m + 63) >> 6
    w = int(width.max())
    front = 64 * (w - width)
    pair, other = np.repeat(np.arange(p), m), np.repeat(np.arange(p), n)
    x, row = codes[at_m[pair] + places(m)], places(m) + front[pair]
    y, col = codes[at_n[other] + places(n)], places(n) + front[other]
    letters = alphabet
    if alphabet > ALPHABET:  # letters by the pair; those that are in no row are alike
        known, x = np.unique(pair << 32 | x, return_inverse=True)
        start = np.searchsorted(known, np.arange(p) << 32)
        x, want, letters = x - start[pair], other << 32 | y, int(np.diff(start, append=len(known)).max()) + 1
        found = np.minimum(np.searchsorted(known, want), len(known) - 1)
        y = np.where(known[found] == want, found - start[other], letters - 1)
    peq = np.zeros((p, letters + 1, w), np.uint64)  # the last letter is that of the common starts
    np.bitwise_or.at(peq, (pair, x, row >> 6), one << (row & 63).astype(np.uint64))
    for i in range(w - int(width.min())):
        peq[width < w - i, letters, i] = full
    above, below, k, n, m = int((off + n - m).max()), int(off.max()), 2 * off + n - m + 1, n + front, m + front
    cols, words = int(n.max()), np.arange(w)
    # a column's letters as places in peq, last column first: the words at hand read a slice of it from top to bottom
    text = np.tile((np.arange(p) * (letters + 1) + letters) * w, (cols, 1))
    text[cols - 1 - col, other] = (other * (letters + 1) + y) * w
    flat, down_to = peq.ravel(), words[:, None]
    first, last = np.maximum(0, 64 * words - below), np.minimum(cols - 1, 64 * words + 63 + above)  # columns of each word
    steps = cols + w - 1
    los, his = np.searchsorted(last + words, np.arange(steps)).tolist(), np.searchsorted(first + words, np.arange(steps), "right").tolist()
    lowest = np.searchsorted(first, np.arange(cols), "right") - 1
    told = np.full(steps, -1)  # the word whose last row a step adds up: the lowest one of its column
    told[np.arange(cols) + lowest] = lowest
    vp, vn = np.full((w, p), full), np.zeros((w, p), np.uint64)
    up, down = np.ones((w + 1, p), np.uint64), np.zeros((w + 1, p), np.uint64)  # +1 or -1 that enters each word from above
    top, end, least, score, before = np.uint64(63), ((m - 1) & 63).astype(np.uint64), int(n.min()), m.copy(), 0
    out, own = k + 1, np.arange(p)
    for t, (lo, hi, low) in enumerate(zip(los, his, told.tolist(), strict=True)):
        if lo >= hi:
            continue
        if lo != before:  # the word above has left the band
            up[lo], down[lo], before = one, 0, lo
        eq, pv, mv, plus, minus = flat.take(text[cols - 1 - t + lo : cols - 1 - t + hi] + down_to[lo:hi]), vp[lo:hi], vn[lo:hi], up[lo:hi], down[lo:hi]
        xv = eq | mv
        eq |= minus
        xh = eq & pv
        xh += pv
        xh ^= pv
        xh |= eq
        ph = xh | pv
        np.invert(ph, ph)
        ph |= mv
        mh = pv & xh
        more, less = ph >> top, mh >> top
        if hi == w:
            more[-1], less[-1] = (ph[-1] >> end) & one, (mh[-1] >> end) & one
        if low >= 0:
            change = more[low - lo].view(np.int64) - less[low - lo].view(np.int64)
            score += change if t - low < least else np.where(n > t - low, change, 0)
        ph <<= one
        ph |= plus
        mh <<= one
        mh |= minus
        np.bitwise_and(ph, xv, mv)
        ph |= xv
        np.invert(ph, ph)
        np.bitwise_or(mh, ph, pv)
        up[lo + 1 : hi + 1], down[lo + 1 : hi + 1] = more, less
        if t % 64 == 63 and low == hi - 1:
            over = n <= t - low
            gone = over | (_least_costs(vp, vn, up, down, lo, hi, t, n - m, score - np.maximum(m - 64 * hi, 0), end if hi == w else None) > k)
            if 4 * gone.sum() >= len(own):
                out[own[over]] = score[over]
                own, n, m, k, end, score = (x[~gone] for x in (own, n, m, k, end, score))
                if not len(own):
                    break
                text, vp, vn, up, down = (x[:, ~gone] for x in (text[: cols - 1 - t + hi], vp, vn, up, down))
    out[own] = score
    return out


def _least_costs(vp, vn, up, down, lo: int, hi: int, t: int, drift: np.ndarray, cost: np.ndarray, end: np.ndarray | None) -> np.ndarray:
    """A lower bound on the cost of every path through the columns that the words lo to hi - 1 have reached after step t.

    ``cost`` is that of the last word's last row. The rows' steps lead from there to the ends of all words; neighbours differ by one
    at most, so the 64 rows between two ends cost no less than half of what both cost less 64. A path that is not on the last
    corner's diagonal, ``drift`` off the first one's, has as many edits to go."""
    held = np.full((hi - lo, len(cost)), 0xFFFFFFFFFFFFFFFF, np.uint64)
    if end is not None:
        held[-1] >>= np.uint64(63) - end
    rise = np.bitwise_count(vp[lo:hi] & held).astype(np.int64) - np.bitwise_count(vn[lo:hi] & held)
    turn = up[lo:hi].view(np.int64) - down[lo:hi].view(np.int64)  # from a word's first row to the column of the word above
    back = np.cumsum((rise - turn)[::-1], axis=0)[::-1] - (rise - turn)
    bottom = cost - back
    ahead = (t + 1 - 65 * np.arange(lo, hi))[:, None] - drift
    return ((2 * bottom - rise - 64) // 2 + np.maximum(np.maximum(ahead - 64, -ahead), 0) - 2).min(axis=0)


def _similar(similarity: float):
    """Pairs (a, b, ta, tb) with an edit similarity in characters of at least ``similarity``.

    The edit distance in words comes first, which costs a fraction. It bounds the one in characters from above: as many of the
    longest words as it counts, with a space each. Most true pairs are settled so; the bound never errs, and what is left is
    aligned by characters, as far as the allowed distance reaches."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "ta", 8 << 20):
                rows, words, longest = part.num_rows, [], []
                for c in ("ta", "tb"):
                    h, line, size = sized_hashes(part.column(c))
                    words += [(h >> np.uint64(32)).astype(np.uint32), np.bincount(line, minlength=rows)]
                    longest.append(line << 32 | (1 << 31) - size)
                chars = [pc.utf8_length(part.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ta", "tb")]
                most = np.floor(np.maximum(*chars) * (1 - similarity) + 1e-9).astype(np.int64)
                longest, n = np.sort(np.concatenate(longest)), words[1] + words[3]
                pair, cost = longest >> 32, np.cumsum((1 << 31) + 1 - (longest & 0xFFFFFFFF))
                cost -= np.append(0, cost)[np.cumsum(n) - n][pair]
                may = np.bincount(pair[cost <= most[pair]], minlength=rows)  # words that can differ within the bound
                near = flat_distances(*words, may) <= may
                later = np.flatnonzero(~near)
                codes = [np.frombuffer("".join(part.column(c).take(pa.array(later, pa.int64())).to_pylist()).encode("utf-32-le"), np.uint32) for c in ("ta", "tb")]
                near[later] = flat_distances(codes[0], chars[0][later], codes[1], chars[1][later], most[later]) <= most[later]
                yield part.select(["a", "b"]).filter(pa.array(near))

    return run


def line_groups(
    docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, similarity: float, min_words: int, blocks: int, most_bits: int, min_chars: int
) -> tuple[DataFrame, DataFrame]:
    """All judged lines (h1, h2, doc_id, line_no, lid) and, for lines in a group of several, h1, h2 and keep."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    schema = "doc_id long, line_no int, h1 long, h2 long, wordy boolean, len int, sig long, norm string"
    lines = scratch.store(texts.mapInArrow(_sketch(min_words), schema).withColumn("rid", F.monotonically_increasing_id()), "lines")
    n, low, high = lines.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    if n and -(2**31) <= low and high < 2**31:  # a decimal costs several times as much
        lid = F.shiftleft("doc_id", 32) + F.col("line_no")
    else:
        lid = (F.col("doc_id").cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col("line_no")).cast("decimal(38,0)")
    placed = lines.select("rid", "h1", "h2", "doc_id", "line_no", lid.alias("lid"))

    # of equal lines, one stands for all
    equal = placed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("rid").alias("rid"), F.min("lid").alias("lid")).where("n > 1")
    equal = scratch.store(equal.select("h1", "h2", "rid", "lid"), "equal-lines")
    few = equal.count() <= 500_000  # their list is broadcast only if it is short
    first = equal.select("h1", "h2", F.col("rid").alias("_first"))
    compared = lines.where(F.col("wordy") | (F.col("len") >= min_chars)).select("rid", "h1", "h2", "norm")
    compared = compared.join(F.broadcast(first) if few else first.hint("merge"), ["h1", "h2"], "left").where("_first is null or _first = rid").select("rid", "norm")
    buckets = max(8, -(-n * blocks // BUCKET_KEYS))
    sent = scratch.store(compared.mapInArrow(_messages(buckets, blocks), "bucket int, data binary"), "key-messages")
    met = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_meet, "key long, id long")
    shared = scratch.store(met.unionByName(sent.where("bucket < 0").select("data").mapInArrow(_open, "key long, id long")).distinct(), "shared-keys")
    members = shared.join(lines.select(F.col("rid").alias("id"), "sig", "len").hint("merge"), "id")

    def fits(a, b):
        near = F.bit_count(a["sig"].bitwiseXOR(b["sig"])) <= most_bits
        return near & (F.least(a["len"], b["len"]) >= F.greatest(a["len"], b["len"]) * similarity)

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = scratch.store(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "wanted-lines")
        small = wanted.count() <= 500_000  # as above
        texts = scratch.store(lines.select("rid", "norm").join(F.broadcast(wanted) if small else wanted.hint("merge"), "rid"), "line-texts")
        side = lambda x: texts.select(F.col("rid").alias(x), F.col("norm").alias(f"t{x}")).hint("merge")
        tasks = max(scratch.spark.sparkContext.defaultParallelism, -(-pairs.count() // 20_000))  # few bytes, much work
        return pairs.join(side("a"), "a").join(side("b"), "b").repartition(tasks).mapInArrow(_similar(similarity), "a long, b long")

    scratch.drop(sent)
    groups = linked_groups(members, scratch, verify, fits, likely_first=True, keys=shared)
    nodes = placed.join(groups.select(F.col("node").alias("rid"), "component").hint("merge"), "rid")
    held = nodes.select("h1", "h2", "rid", "lid", "component").unionByName(equal.withColumn("component", F.lit(None).cast("long")))
    held = held.groupBy("h1", "h2").agg(F.min("rid").alias("rid"), F.min("lid").alias("lid"), F.max("component").alias("component"))
    held = scratch.store(held.select("h1", "h2", "lid", F.coalesce("component", "rid").alias("class")), "classes")
    keep = scratch.store(held.groupBy("class").agg(F.min("lid").alias("keep")), "first-lines")
    return placed, scratch.store(held.join(keep.hint("merge"), "class").select("h1", "h2", "keep"), "kept-lines")


def removed_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.75, min_words: int = 5, blocks: int = 20, most_bits: int = 22, min_chars: int = 20
) -> DataFrame:
    """(doc_id, lines): the numbers, from 0, of the lines to remove from each document that loses any.

    Lines with fewer than ``min_words`` words are not judged and stay; lines without a letter or digit always
    do. Equal judged lines are removed whatever their length. Lines of fewer than five words and fewer than
    ``min_chars`` characters are not compared with lines that differ: "page 12" is not "page 13". Null and empty
    texts have no judged line. A null id's lines stay. Repeated rows of one id share its line numbers, so their
    lines stay in both or go from both. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    seen, keep = line_groups(docs, scratch, id_col, text_col, similarity, min_words, blocks, most_bits, min_chars)
    gone = seen.join(keep.hint("merge"), ["h1", "h2"]).where("lid <> keep").select("doc_id", "line_no")
    out = scratch.store(gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("lines")), "removed-lines")
    scratch.drop_since(0, out)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, with the duplicate lines cut out of the text. Documents that lose no line are
    unchanged, byte for byte; one that loses all has an empty text."""
    gone = removed_lines(docs, id_col, text_col, **options).select(F.col("doc_id").alias("_id"), F.col("lines").alias("_lines"))
    row = F.struct(*[F.col(c) for c in docs.columns])
    joined = docs.select(row.alias("_row"), F.col(id_col).cast("long").alias("_own")).join(gone.hint("merge"), F.col("_own") == F.col("_id"), "left")
    text = F.col("_row")[text_col]
    lines = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("_lines", i))
    cut = F.when(F.col("_lines").isNull(), text).otherwise(F.array_join(lines, "\n"))
    return joined.select(*[cut.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
