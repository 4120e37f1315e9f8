"""Exact, substring, near and line deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import common, exact_dedup, kernels, line_dedup, near_dedup, substring_dedup
from tidelog.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        out += [(i, low, len(ids), low is None or i == low, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(make_docs, odd_rows, weak):
    digest = (lambda c: F.substring(exact_dedup.sha256_of(c), 1, 0)) if weak else exact_dedup.sha256_of
    got = exact_dedup.exact_dedup(make_docs(odd_rows), digest=digest, batches=3).collect()
    want = brute_exact(odd_rows)
    if weak:  # every text collides; only whole texts tell groups apart
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter(x[:4] for x in want.elements())
    else:
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got) == want


@pytest.mark.parametrize("weak", [False, True])
def test_exact_later_runs(spark, make_docs, odd_rows, tmp_path, weak):
    """A second and third run meet the state, and the texts, of the runs before."""
    digest = (lambda c: F.substring(exact_dedup.sha256_of(c), 1, 0)) if weak else exact_dedup.sha256_of
    runs = [odd_rows, [(1, "short  text"), (6, "new"), (30, odd_rows[0][1])], [(4, "new"), (31, "newer"), (None, "short text")]]
    seen = []
    for k, rows in enumerate(runs):
        docs = make_docs(rows)
        if k == 1:  # from files, read by their own locators
            docs.write.parquet(str(tmp_path / "in"))
            docs = spark.read.parquet(str(tmp_path / "in"))
        got = exact_dedup.exact_dedup(docs, digest=digest, state_dir=str(tmp_path / "state")).collect()
        seen += rows
        ids = Counter(rows)
        want = Counter()
        for i, t in ids:
            same = [j for j, u in seen if re.sub(r"[\x20\x09-\x0D]+", " ", u or "") == re.sub(r"[\x20\x09-\x0D]+", " ", t or "")]
            low = min((j for j in same if j is not None), default=None)
            want[i, low, len(same), low is None or i == low] += ids[i, t]
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    assert exact_dedup.exact_dedup(make_docs([]).limit(0), digest=digest, state_dir=str(tmp_path / "state")).count() == 0


@pytest.mark.parametrize(("kind", "weak"), [("renamed", False), ("derived", True), ("exploded", False), ("exploded", True), ("gone", True)])
def test_exact_later_runs_of_any_input(spark, tmp_path, kind, weak):
    """Kept state with a renamed column, a text made from others, rows that share a place in a file, and files that have changed since."""
    digest = (lambda t: F.unhex(F.sha2(F.substring(t, 1, 2), 256))) if weak else exact_dedup.sha256_of
    parts = [[(5, "Abc X"), (6, "abc y"), (7, "zz")], [(4, "abc  x"), (8, "ABC Y"), (9, "abc z"), (3, "zz")], [(2, "abc z"), (10, "new"), (11, "abc x"), (1, "ab")]]
    seen = []
    for k, part in enumerate(parts):
        path = f"file://{tmp_path}/{'same' if kind == 'gone' else k}"
        spark.createDataFrame([(i, t, [t, t + "!"]) for i, t in part], "doc_id long, body string, words array<string>").coalesce(1).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        rows = part
        if kind == "derived":
            docs, rows = docs.withColumn("body", F.lower("body")), [(i, t.lower()) for i, t in part]
        if kind == "exploded":
            docs, rows = docs.select("doc_id", F.explode("words").alias("body")), [(i, x) for i, t in part for x in (t, t + "!")]
        got = exact_dedup.exact_dedup(docs, text_col="body", digest=digest, state_dir=f"file://{tmp_path}/state").collect()
        seen += rows
        want = {(i, r[1], r[2]) for (i, t), r in zip(seen, _exact_rows(seen))}
        assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, k, n) for (i, t), (i2, k, n) in zip(seen, _exact_rows(seen)) if (i, t) in rows} <= want


def _exact_rows(rows):
    """(id, smallest id of its text, rows of its text) of every row."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    return [(i, min(j for j, u in rows if norm(u) == norm(t)), sum(norm(u) == norm(t) for _, u in rows)) for i, t in rows]


def test_exact_empty(make_docs):
    assert exact_dedup.exact_dedup(make_docs([]).limit(0)).count() == 0


def brute_substring(rows, width):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("hot_keys", [2000, 3])
def test_substring(make_docs, odd_rows, monkeypatch, hot_keys):
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    got = substring_dedup.substring_dedup(make_docs(odd_rows), width=50).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == brute_substring(odd_rows, 50)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.substring_dedup(make_docs([]).limit(0)).count() == 0


def test_same_id_other_text(make_docs):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (2, "z " + a), (2, b), (3, b)]
    got = substring_dedup.substring_dedup(make_docs(rows), width=50).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == brute_substring(rows, 50)


def shingle_sets(rows, width):
    out = []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    return out


def brute_near(rows, width):
    sets = shingle_sets(rows, width)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(sets)):
        groups[find(k)].append(sets[k][0])
    return Counter((sets[k][0], len(sets[k][1]), sets[k][0] if sets[k][0] is None or not sets[k][1] else min(groups[find(k)])) for k in range(len(sets)))


def test_near(make_docs, odd_rows):
    got = near_dedup.near_components(make_docs(odd_rows), width=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(odd_rows, 4)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_components(make_docs([]).limit(0), width=4).count() == 0


def test_near_shared_ids(make_docs):
    """Rows that share an id each go by their own text."""
    b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "bc")
    rows = [(3, b + " more"), (5, b), (9, b + " more"), (5, c), (7, c), (None, c), (11, None), (11, c + " end"), (11, "")]
    got = near_dedup.near_components(make_docs(rows), width=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(rows, 4)
    assert {(r.doc_id, r.component_id) for r in got if r.kept} == {(3, 3), (5, 5), (None, None), (11, 11)}


def test_near_recall():
    """At a similarity of 0.8 nearly every pair shares a band, for few and many shingles."""
    rng = np.random.default_rng(9)
    for n in (9, 45, 450):
        missed = 0
        for _ in range(200):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            own = rng.integers(0, 1 << 63, (2, max(1, n // 9)), dtype=np.uint64)[:, : n // 8]
            keys = [set(kernels.band_keys(kernels.one_permutation(np.unique(np.concatenate([both, x])), 160), 5).tolist()) for x in own]
            missed += not keys[0] & keys[1]
        assert missed == 0


def test_near_dense_group(make_docs, monkeypatch):
    """A group in which many pairs are just below and just above the threshold, in small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.choice(200, int(rng.integers(0, 9)), replace=False):
            w[p] = f"e{rng.integers(0, 10**6) if i % 2 else p}"
        rows.append((100 - i, " ".join(w)))
    got = near_dedup.near_components(make_docs(rows), width=5).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(rows, 5)


def test_components(spark):
    path = [(k, k + 1) for k in range(40)]
    edges = spark.createDataFrame([*path, *((100, 100 + k) for k in range(1, 30)), (205, 201), (203, 205)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {k: 201 for k in (201, 203, 205)}
    assert components(edges.limit(0)).count() == 0


def test_kernels():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    w = kernels.window_hashes(h, 7)
    assert len(w) == 194 and len(set(w.tolist())) == 194
    assert (kernels.window_hashes(h[50:90], 7) == w[50:84]).all()
    assert len(kernels.window_hashes(h[:3], 7)) == 0
    m = kernels.sliding_min(h, 25)
    assert m.tolist() == [h[k : k + 25].min() for k in range(176)]
    hits = 0
    for k in range(60):  # agreement of signatures estimates the Jaccard similarity, for small sets too
        n = 20 + 5 * k
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: int(0.9 * len(a))], rng.integers(0, 1 << 63, len(a) // 10, dtype=np.uint64)]))
        same = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        hits += (kernels.one_permutation(a, 160) == kernels.one_permutation(b, 160)).mean() - same
    assert abs(hits / 60) < 0.05


def brute_lines(rows, chars, docs):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\r\x0b\x0c"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars and i is not None:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("hot_keys", [2000, 3])
def test_lines(make_docs, odd_rows, monkeypatch, hot_keys):
    """With 3, the common line is hot and the others are streamed."""
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    line, other = "A line that is long enough to count as one, é!", "Another line of more than forty code points, too."
    rows = [*odd_rows, *((k, f"{line}\nown {k}\n {line.upper().replace('É', 'é')}\x0b\n\n{line[:30]}") for k in range(30, 38)), (37, line), (38, line + "\r"), (None, line)]
    rows += [(k, f"{other}\n{k}") for k in range(50, 56)] + [(60, other[1:]), (61, other[1:]), (62, "\n" * 20_000 + line)]
    docs = make_docs(rows)
    got = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == brute_lines(rows, 40, 5)
    assert any(r.n_dropped for r in got)
    empty = make_docs([]).limit(0)
    assert line_dedup.apply_bitmaps(empty, line_dedup.line_bitmaps(empty)).count() == 0


def test_lines_plan(make_docs):
    """The sorted stream takes one range partitioning, and no other exchange of its rows before it decides."""
    rows = [(k, f"line {k % 7} that is long enough to be counted by the operator") for k in range(60)]
    keyed = make_docs(rows).select("doc_id", F.unhex(F.md5("text")).alias("key"), F.lit(0).alias("mark"), F.lit(1).alias("n_lines"), F.lit(0).alias("pos"))
    plan = line_dedup.lost_lines(keyed, 5)._jdf.queryExecution().executedPlan().toString()
    stream = plan[: plan.index("BroadcastHashJoin [key")]
    assert "rangepartitioning(key" in stream and "hashpartitioning" not in stream


def test_keep_runs(spark):
    d = spark.createDataFrame([([1, 2, 3, 7, 9, 10], 11), ([], 2), ([0, 1], 2), ([0], 3)], "p array<int>, n int")
    got = d.select(line_dedup.keep_runs(F.col("p"), F.col("n")).alias("r")).collect()
    assert [[tuple(x) for x in g.r] for g in got] == [[(0, 1), (4, 3), (8, 1)], [(0, 2)], [], [(1, 2)]]


@pytest.mark.parametrize("n", [0, 1, 500])
def test_marked(spark, n):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"))
    got = common.marked(rows, "doc_id", spark.range(n).select((F.col("id") * 7).alias("id"))).collect()
    true = {r.doc_id for r in got if r.maybe}
    assert len(got) == 20_000 and {7 * k for k in range(n)} <= true and len(true) < n * 1.2 + 5


def test_beside(spark, tmp_path, monkeypatch):
    """A hot key, others, nulls and no rows."""
    spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 9_000).alias("k"), "id").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    hot = {r[0] for r in rows.filter("k = 7 or k is null").select(F.xxhash64("k")).distinct().collect()}
    assert hot <= set(common.hot_hashes(rows, ["k"])) and len(common.hot_hashes(rows, ["k"])) < 16 * common.HOT_KEYS
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    assert set(common.hot_hashes(rows, ["k"])) == hot
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # then many partitions are empty
    try:
        assert set(common.hot_hashes(rows.repartition(3), ["k"])) == hot
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = Counter((r.k, r.id) for r in rows.filter("k is not null").collect())
    got = common.beside_least(rows.filter("k is not null"), ["k"], "id").collect()
    low, high = {}, {}
    for k, i in want:
        low[k], high[k] = min(low.get(k, i), i), max(high.get(k, i), i)
    assert Counter((r.k, r.id) for r in got) == want and all(r.low == low[r.k] and r.high == high[r.k] for r in got)
    assert common.beside_least(rows.limit(0), ["k"], "id").count() == 0
