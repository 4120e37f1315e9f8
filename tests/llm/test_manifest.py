"""URL filters, importance resampling and Merkle manifests."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidelog.llm import importance, merkle, queries, url_filter
from tidelog.llm.url_filter import PASSED, UNIT, Rule

PAGES = "page_id long, url string, html string, host string, rule string, own string, n string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x") for i, u, h in rows], PAGES).repartition(3)


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("https://WWW.Example.COM:80/De/a?b#c", "www.example.com:80", "/De/a"), ("http://x.org?q=/fr/", "x.org", ""), ("http://x.org#/fr/", "x.org", ""), ("x://a//b", "a", "//b"),
        ("no scheme/at all", "", ""), (None, "", ""), ("", "", ""), ("://", "", ""), ("a://b://c/d", "b:", "//c/d"), ("http://ÄB.net/ü\n/x", "Äb.net", "/ü\n/x"),
    ],
)
def test_url_parts(spark, url, host, path):
    u = spark.createDataFrame([(url,)], "url string")
    assert tuple(u.select(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).first()) == (host, path)


def test_rules(spark):
    cases = {
        "http://a.net/x": ("net/", "block"), "http://net/": ("net/", "block"), "http://example.net/en/x": ("example.net/en/", "allow"), "http://a.example.net/en/": ("example.net/en/", "allow"),
        "http://example.net/en": ("net/", "block"), "http://myexample.net/en/": ("net/", "block"), "http://lone.net": (None, "allow"), "http://xnet/": (None, "allow"),
        "http://b.example.com/de/": ("example.com/de/", "block"), "http://b.example.com/fr/": (None, "allow"), "http://b.org/fr/1": ("org/fr/", "allow"), "http://b.org/FR/1": (None, "allow"), None: (None, "allow"),
    }
    # one url of a host is no reason to block its others, so each host also has three without a rule
    rows = [(k, u, None) for k, u in enumerate(cases)] + [(99, f"http://b.example.com/{k}", "") for k in range(3)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages_of(spark, rows), queries.RULES).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    tie = url_filter.rule_of(F.lit("a.bc"), F.lit("/d"), [Rule("bc", "/d", "x"), Rule("a.bc", "", "y"), Rule("zz", "/", "z")])
    assert tuple(spark.range(1).select(*tie).first()) == ("a.bc", "y")
    with pytest.raises(ValueError):
        url_filter.rule_of(F.lit(""), F.lit(""), [Rule(str(k), "/", "block") for k in range(url_filter.MOST_RULES + 1)])


LINKS = [
    ('<a href="http://b.net/x">', ["b.net"]), ("<A class='y' HREF = //C.org/fr/>", ["c.org"]), ("<a href=https://d.com?x>..<a\nhref='//e.com#y'>", ["d.com", "e.com"]),
    ('<a href="/local"><a href="mailto:x@y.z"><link href="http://no.net/">', []), ('<abbr href="http://no.net">', []), ('<a data-href="http://no.net">', []), ("<a " * 20_000, []), (None, []), ("", []),
]


@pytest.mark.parametrize(("html", "want"), LINKS)
def test_links(spark, html, want):
    p = spark.createDataFrame([("http://a.net/", html)], "url string, html string")
    assert [r.host for r in url_filter.links_of(p, "url", "html").collect()] == want


def brute_verdicts(rows, rules, rounds):
    """Verdicts from a dense loop over hosts, with links taken by another pattern."""
    split = lambda u: ((m := re.search(r"://([^/?#]*)([^?#]*)", u or "")) and (m[1].lower(), m[2])) or ("", "")
    rule = lambda h, p: max((r for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)), key=lambda r: (len(r.name), len(r.host)), default=None)
    urls = [(i, *split(u)) for i, u, _ in rows]
    seen, n = defaultdict(list), Counter()
    for _, h, p in urls:
        seen[h].append(rule(h, p))
    for (_, src, _), (_, _, html) in zip(urls, rows):
        for to in re.findall(r'href="(http://[^"]*)"', html or ""):
            h, p = split(to)
            if src and h:
                seen[h].append(rule(h, p))
                if src != h:
                    n[src, h] += 1
    score = {}
    for kind, verdict, edges in (("trust", "allow", n), ("distrust", "block", {(b, a): k for (a, b), k in n.items()})):
        own = {h: UNIT * sum(r is not None and r.verdict == verdict for r in rs) // len(rs) * (1000 - PASSED) // 1000 for h, rs in seen.items()}
        total, now = Counter(), dict(own)
        for (a, _), k in edges.items():
            total[a] += k
        for _ in range(rounds):
            got = Counter()
            for (a, b), k in edges.items():
                got[b] += now[a] * k // total[a]
            now = {h: own[h] + got[h] * PASSED // 1000 for h in own}
        score[kind] = now
    bad = {h for h in seen if score["distrust"][h] >= url_filter.LEAST and score["distrust"][h] > score["trust"][h]}
    return sorted((i or -1, h, p, r.name if (r := rule(h, p)) else "", r.verdict if r else "block" if h in bad else "allow") for i, h, p in urls)


@pytest.mark.parametrize("hot_keys", [2000, 3])
def test_propagation(spark, monkeypatch, hot_keys):
    from tidelog.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    rng = random.Random(5)
    hosts = [f"h{k}.{end}" for k in range(12) for end in ("com", "org", "info")] + ["bad1.net", "bad2.net", "hub.com"]
    rows = []
    for k in range(90):
        src = "hub.com" if k % 3 == 0 else rng.choice(hosts)
        to = "".join(f'<a href="http://{rng.choice(hosts)}/{rng.choice(["fr/", "de/", ""])}">x</a>' for _ in range(rng.randint(0, 3)))
        rows.append((k, f"http://{src}/{rng.choice(['fr/', 'en/'])}", to))
    rows += [(None, None, None), (7, "http://h1.com/fr/", ""), (7, "http://h1.com/fr/", "")]
    rows += [(200, "http://farm.com/", '<a href="http://bad3.net/x">'), (201, "http://clean.com/", '<a href="http://good.org/fr/">')]
    got = url_filter.filter_urls(pages_of(spark, rows), queries.RULES, rounds=6)
    assert sorted((r.page_id or -1, r.host, r.path, r.rule or "", r.verdict) for r in got.collect()) == brute_verdicts(rows, queries.RULES, 6)
    verdict = {r.page_id: r.verdict for r in got.collect()}
    assert verdict[200] == "block" and verdict[201] == "allow"
    assert url_filter.filter_urls(pages_of(spark, rows[:1]).limit(0), queries.RULES).count() == 0


def brute_features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, percent, longest, buckets, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw = Counter(bucket(f) for _, t in rows for f in brute_features(t, longest)[1])
    aim = Counter(bucket(f) for t in target for f in brute_features(t, longest)[1])
    s, t = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets))))
    out = []
    for i, text in rows:
        words, found = brute_features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        out.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, -r[3], -r[2]))
    drawn = may[: percent * len(may) // 100]
    return Counter([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in may[len(drawn) :]] + [(*r, None) for r in out if r[1] < least])


@pytest.mark.parametrize(("longest", "block"), [(1, 1 << 22), (3, 1 << 22), (2, 64)])
def test_resample(spark, make_docs, odd_rows, monkeypatch, longest, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    rng = random.Random(2)
    rows = odd_rows + [(k, " ".join(rng.choices(["Ab", "cd", "Éf", "g-h", "9", "x\x00y", "ʼn", "Z"], k=rng.randint(0, 60)))) for k in range(100, 160)]
    target = ["cd Éf cd", None, "", "9 9 ab\tg-h"]
    got = importance.resample(make_docs(rows), spark.createDataFrame([(t,) for t in target], "text string"), 40, longest=longest, buckets=97, least_words=20)
    assert Counter(tuple(r) for r in got.collect()) == brute_resample(rows, target, 40, longest, 97, 20)


def test_resample_edges(spark, make_docs):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(make_docs([(1, "a")]).limit(0), none, 10).count() == 0
    got = importance.resample(make_docs([(1, "a b"), (2, None)]), none, 100, least_words=1).collect()
    assert sorted((r.doc_id, r.rank) for r in got) == [(1, 1), (2, None)]
    with pytest.raises(ValueError):
        importance.bucket_counts(none, buckets=importance.MOST_BUCKETS + 1)


def test_ngrams_cross_no_text():
    of, bucket = importance.ngram_buckets([[b"a", b"b"], [], [b"b", b"a", b"b"]], 3, 1 << 20)
    want = [(0, "a"), (0, "b"), (0, "a b"), (2, "b"), (2, "a"), (2, "b"), (2, "b a"), (2, "a b"), (2, "b a b")]
    assert sorted(zip(of.tolist(), bucket.tolist())) == sorted((k, zlib.crc32(f.encode()) % (1 << 20)) for k, f in want)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, arity):
    """The root, and every leaf's siblings."""
    proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, x in enumerate(at):
            start = x - x % arity
            proofs[k] += [level[y] for y in range(start, min(start + arity, len(level))) if y != x]
        level, at = [H(*level[y : y + arity]) for y in range(0, len(level), arity)], [x // arity for x in at]
    return level[0], proofs


def brute_manifest(rows, arity):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(field, r))
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = brute_tree([leaf(r) for r in groups[g]], arity)
    root, above = brute_tree([trees[g][0] for g in names], arity)
    return Counter((r[0], leaf(r), trees[g][0], root, H(*trees[g][1][k], *above[j])) for j, g in enumerate(names) for k, r in enumerate(groups[g]))


@pytest.mark.parametrize(("arity", "depth", "n"), [(2, 14, 300), (2, 2, 300), (2, 1, 97), (3, 2, 260), (3, 14, 30), (5, 1, 131)])
def test_manifest(spark, arity, depth, n):
    rng = random.Random(n)
    langs = [None, "", "en", "en", "en", "zz", "Ä", "é", "\U0001f600"]
    rows = [(rng.choice([None, *range(n)]), rng.choice(langs), rng.choice([None, "", "text é " * rng.randint(1, 50)])) for _ in range(n)]
    rows += [(n, "solo", "x")] + [(n + 1, "en", "same")] * 9 + [(n + 1, "en", "y" * 300_000)]
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, lang string, text string, digest string, size string").repartition(5)
    digest = merkle.leaf_digest(F.col("doc_id"), F.col("lang"), F.col("text"))
    changed = merkle.leaf_digest(F.col("doc_id"), F.col("lang"), F.concat("text", F.lit("!")))
    proven = merkle.manifest(docs, digest, "lang", ["doc_id"], arity, depth, carry={"changed": changed})
    got = merkle.folded(proven, arity=arity).collect()
    assert Counter((r.doc_id, r.digest.hex(), r.subroot.hex(), r.root.hex(), H(r.proof.hex())) for r in got) == brute_manifest(rows, arity)
    assert all(r.verified for r in got)
    forged = merkle.folded(proven, "changed", arity).collect()
    assert all(r.verified == (r.changed == r.digest) for r in forged) and not all(r.verified for r in forged)


@pytest.mark.parametrize("n", [0, 1, 2, 64, 65])
def test_manifest_sizes(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("lang"), F.lit("t").alias("text"))
    proven = merkle.manifest(docs, merkle.leaf_digest(F.col("doc_id"), F.col("lang"), F.col("text")), "lang", ["doc_id"], depth=3)
    got = Counter((r.doc_id, r.digest.hex(), r.subroot.hex(), r.root.hex(), H(r.proof.hex())) for r in proven.collect())
    assert got == (brute_manifest([(k, "a", "t") for k in range(n)], 2) if n else Counter())


def test_one_common_row(spark):
    """A row that is repeated over and over doesn't stay in one partition."""
    docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("a").alias("lang"))
    forest = merkle.grow(docs.withColumn("digest", merkle.leaf_digest(F.col("doc_id"))), F.col("lang"), ["doc_id"])
    sizes = [r[1] for r in forest.kept.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 4000 / len(sizes)


def test_manifest_over_partitions(spark):
    """Groups that end in a later partition, before other groups; and a result whose partitions are merged."""
    rows = [(k, lang, "t") for k, lang in enumerate(["a"] * 30 + ["b"] * 200 + ["c"] * 41 + [None] * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        proven = merkle.manifest(docs, merkle.leaf_digest(F.col("doc_id"), F.col("lang"), F.col("text")), "lang", ["doc_id"], depth=3)
        for result in (proven, proven.coalesce(1)):
            got = merkle.folded(result).collect()
            assert Counter((r.doc_id, r.digest.hex(), r.subroot.hex(), r.root.hex(), H(r.proof.hex())) for r in got) == brute_manifest(rows, 2)
            assert all(r.verified for r in got)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tampered_past_long(spark, tmp_path):
    """Adding 1 to the largest number of characters gives a longer number, and no error."""
    rows = [(k, "en", "s", (1 << 63) - 1, "t") for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.verified for r in queries.op13_merkle(spark, str(tmp_path)).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 7 != 0 for k in range(20)}
