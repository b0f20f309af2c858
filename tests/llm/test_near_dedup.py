"""Near-duplicates against all pairs, and the estimate against the truth."""

import random
import re

import numpy as np

from retrospark.llm import near_dedup, queries
from retrospark.llm.hashing import shingle_sets
from tests.conftest import SF


def word_set(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = {i: word_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    for a in ids:
        for b in {x for s in sets[a] for x in where[s] if x > a}:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[a]:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def rows_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.op1_near_dedup(spark, SF)) == brute(docs)


def test_cases_and_families(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "a b c d e f"), (7, "A B C D E F"), (8, "x " * 50_000)]
    base = [word() for _ in range(150)]
    for i in range(260):  # a family whose members are near and beyond the threshold, and not all near its first
        copy = [word() if r.random() < (i % 13) / 200 else w for w in base]
        rows.append((20 + i, " ".join(copy)))
    shared = " ".join(word() for _ in range(40))
    rows += [(400 + i, " ".join(word() for _ in range(60)) + " " + shared) for i in range(40)]
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in rows], "doc_id long, text string, n long, component string".replace("n long", "n string"))
    assert rows_of(near_dedup.near_duplicates(df)) == brute(rows)
    old = near_dedup.CHUNK_SETS
    try:
        near_dedup.CHUNK_SETS = 60  # families of many chunks
        assert rows_of(near_dedup.near_duplicates(df)) == brute(rows)
    finally:
        near_dedup.CHUNK_SETS = old
    twice = near_dedup.near_duplicates(df.filter("doc_id in (3, 8)").union(df.filter("doc_id = 3"))).collect()
    assert sorted((r.doc_id, r.component_id) for r in twice) == [(3, 3), (3, 3), (8, 8)]
    none = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d e")], "doc_id long, text string")).collect()
    assert [(r.component_id, r.kept) for r in none] == [(None, False)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_links_of_a_large_family_are_few(spark):
    """A family of near copies gives fewer links than it has members, and no class has more than a seat and its host's."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if r.random() > 0.004 else f"v{r.randrange(10**9)}" for w in base)) for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old, seen = near_dedup.materialize, {}
    try:
        near_dedup.CHUNK_SETS = 500
        near_dedup.materialize = lambda frame, name: seen.setdefault((name, len(seen)), old(frame, name))
        got = rows_of(near_dedup.near_duplicates(df))
    finally:
        near_dedup.CHUNK_SETS, near_dedup.materialize = 2048, old
    assert got == brute(rows)
    counts = [(name, f.count()) for (name, _), f in seen.items() if name in ("classes", "pods", "links")]
    classes = dict(counts)["classes"]
    assert dict(counts)["pods"] < 1.5 * classes and sum(n for name, n in counts if name == "links") < classes


def test_estimate():
    r = random.Random(5)
    for share in (0.3, 0.6, 0.75, 0.9):
        common = [f"w{r.random()}" for _ in range(int(1000 * share))]
        a, b = (" ".join(common + [f"w{r.random()}" for _ in range(1000 - len(common))]) for _ in range(2))
        values, offsets = shingle_sets([a.encode(), b.encode(), None])
        regs = near_dedup.setsketch(values, offsets).astype(int)
        merged = near_dedup.setsketch(np.unique(values), np.array([0, len(np.unique(values))]))
        assert (merged[0] == regs[:2].max(axis=0)).all() and not regs[2].any()
        n = np.diff(offsets).astype(float)
        got = near_dedup.joint_similarity(np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()]), regs.shape[1], n[:1], n[1:2])[0]
        x, y = set(values[: offsets[1]]), set(values[offsets[1] : offsets[2]])
        assert abs(got - len(x & y) / len(x | y)) < 0.13


def pair(k):
    """Texts of 8 and 6 shingles, the second's among the first's: similarity 0.75."""
    words = [f"p{k}x{j}" for j in range(12)]
    return " ".join(words), " ".join(words[:10])


def test_pairs_without_a_common_band(spark):
    """Two of 120,000 pairs at the threshold share no band; they are linked all the same."""
    rows = [(i * 10 + j, t) for i, k in enumerate((46633, 52995, 1, 2)) for j, t in enumerate(pair(k))]
    values, offsets = shingle_sets([t.encode() for _, t in rows])
    keys = near_dedup.band_keys(near_dedup.setsketch(values, offsets))
    assert (keys[::2] == keys[1::2]).any(axis=1).tolist() == [False, False, True, True]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dedup.near_duplicates(df)) == brute(rows) == {i: (8 - 2 * (i % 10), i // 10 * 10, i % 10 == 0) for i, _ in rows}


def test_no_link_depends_on_bands(spark):
    """With estimates that pass over every pair, the links are those of all pairs."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    line, rows = " ".join(word() for _ in range(30)), []
    for family in range(12):
        base = [word() for _ in range(r.choice((5, 8, 40, 150, 700)))]
        for i in range(30):
            copy = [word() if r.random() < (i % 10) / 150 else w for w in base]
            rows.append((1000 * family + i, " ".join(copy) + (" " + line if i % 3 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    size, common = near_dedup.CHUNK_SETS, near_dedup.COMMON_IN_SAMPLE
    try:
        near_dedup.CHUNK_SETS = 40  # groups of several chunks
        for near_dedup.COMMON_IN_SAMPLE in (common, 10**6):  # common shingles last, or all in order of their hash
            assert rows_of(near_dedup.near_duplicates(df, slack=-1.0)) == want
    finally:
        near_dedup.CHUNK_SETS, near_dedup.COMMON_IN_SAMPLE = size, common
    # Parities alone let a pair through that reaches the threshold, whatever the widths.
    sets = [np.unique(np.array([hash(x) & (2**54 - 1) for x in word_set(t)], np.uint64)) for _, t in rows]
    n = np.array([len(s) for s in sets])
    bits = near_dedup.parities(np.concatenate(sets), np.concatenate(([0], np.cumsum(n))))
    ids, zeros = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    got = near_dedup.joins_of_parts(zeros, ids, ids, n, zeros, bits, 75, [s.tobytes() for s in sets])
    up = list(range(len(rows)))
    for high, low in got:
        up = [up[low] if x == up[high] else x for x in up]
    label = {i: want[i][1] for i, _ in rows}
    assert len(got) == len(rows) - len(set(label.values()))
    assert all((up[x] == up[y]) == (label[rows[x][0]] == label[rows[y][0]]) for x in range(len(rows)) for y in range(x))


def test_rows_of_one_identifier(spark):
    """A document of two rows ties what they are linked with."""
    x, y = ("one two three four five six", "a b c d e f")
    rows = [(3, x), (5, x), (5, y), (7, y), (9, pair(46633)[0]), (11, "k l m n o"), (11, pair(46633)[1]), (10, "k l m n o")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9), (10, 9), (11, 9), (11, 9)]


def test_firsts_that_reach_the_threshold_meet(spark):
    """Two sets that reach the threshold share one of their first shingles, which is among the fewer ones of the smaller; and
    many shingles make one row for each bucket."""
    r = random.Random(4)
    rows = []
    for k in range(60):
        words = [f"k{k}w{j}" for j in range(r.choice((5, 6, 9, 30, 200)))]
        rows += [(10 * k + i, " ".join(words[: len(words) - r.randrange(1 + len(words) // 5)] + [f"x{k}{i}"] * (i % 2))) for i in range(4)]
    rows.append((9000, None))
    blobs = spark.createDataFrame(rows, "doc_id long, t string").selectExpr("doc_id", "encode(t, 'UTF-8') t").coalesce(2)
    late = np.unique(shingle_sets([t.encode() for _, t in rows[:40]])[0])[::3]
    packed = near_dedup.first_shingles(blobs, late, 5, 75, 7).collect()
    assert len(packed) <= 2 * 7 and {p.bucket for p in packed} == set(range(7))
    held = {}
    for p in packed:
        for i, e in zip(p.ids, p.es, strict=True):
            held.setdefault(i, {})[p.bucket, e >> 1] = e & 1
    sets = {i: word_set(t) for i, t in rows}
    assert all(len(held.get(i, {})) == (len(s) - -(-75 * len(s) // 100) + 1 if s else 0) for i, s in sets.items())
    near = 0
    for x, y in ((x, y) for x in sets for y in sets if x != y and 0 < len(sets[x]) <= len(sets[y])):
        if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
            near += 1
            assert any(held[x][e] for e in held[x].keys() & held[y].keys())
    assert near > 100


def test_same_links_however_shingles_are_dealt(spark):
    """Many buckets and few shingles at once give the same links, also between documents of several sets."""
    r = random.Random(11)
    rows = []
    for family in range(20):
        base = [f"f{family}w{j}" for j in range(r.choice((6, 20, 90)))]
        rows += [(100 * family + i, " ".join(w if r.random() > i / 300 else f"v{r.random()}" for w in base)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    old = near_dedup.FIRSTS_IN_BUCKET, near_dedup.FIRSTS_AT_ONCE
    try:
        near_dedup.FIRSTS_IN_BUCKET, near_dedup.FIRSTS_AT_ONCE = 300, 50
        assert rows_of(near_dedup.near_duplicates(df)) == want
        assert rows_of(near_dedup.near_duplicates(df, slack=-1.0)) == want
    finally:
        near_dedup.FIRSTS_IN_BUCKET, near_dedup.FIRSTS_AT_ONCE = old
    # Document 5 has a small set, which makes it the first by size, and a larger one that is near to a smaller of document 7.
    long, short = pair(1)
    rows = [(5, "a b c d e"), (5, long), (7, short), (8, "a b c d e")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), slack=-1.0).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (7, 5), (8, 5)]


def test_bands_go_when_buckets_are_known(spark):
    """When the exact step writes what it looks at, no table with the bands of all documents is kept any more."""
    df = spark.range(3000).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 12), x -> concat('w', id div 2 * 100 + x))) text")
    put, drop, kept, seen = near_dedup.materialize, near_dedup.discard, {}, []

    def materialize(frame, name):
        if name == "apart":
            seen.append(sum(sum(len(f or ()) for f, in t.select("bands").collect()) for t in kept.values() if "bands" in t.columns))
        out = put(frame, name)
        kept[out._scratch] = out
        return out

    def discard(*frames):
        for f in frames:
            kept.pop(f._scratch)
        drop(*frames)

    try:
        near_dedup.materialize, near_dedup.discard = materialize, discard
        got = rows_of(near_dedup.near_duplicates(df))
    finally:
        near_dedup.materialize, near_dedup.discard = put, drop
    assert seen == [0]
    assert got == {i: (8, i // 2 * 2, i % 2 == 0) for i in range(3000)}
