"""Chat formatting, BPE, decontamination, classifier, sharding, extraction and the pipeline."""

import math
import random
import re
import struct
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import bpe, chat_format, decontaminate, html_extract, quality, queries, sharding

SMALL = "/root/testdata/sf0.001"


def test_template_is_reversible():
    rng = random.Random(3)
    parts = ["\\", "###", "### ", " </turn>\n", "</turn>", ": ", ":", "<", "/", "a", "\n", " ", "é", "user"]
    for _ in range(3000):
        turns = [("".join(rng.choices(parts, k=rng.randint(0, 4))), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for _ in range(rng.randint(0, 4))]
        learn = frozenset(r for r, _ in turns[:2])
        formatted, mask = chat_format.format_turns(turns, learn)
        assert chat_format.parse_turns(formatted) == turns
        assert [chat_format.unescape(formatted[a:b]) for a, b in mask] == [t for r, t in turns if r in learn]


def test_reply_tree(spark):
    rows = [("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 0.2, "assistant", "bad"), ("t", 3, 1, 0.9, "assistant", "good"), ("t", 4, 3, 0.9, "user", None), ("t", 5, 99, 0.1, "user", "orphan"), ("t", 6, 7, 1.0, "u", "cycle"), ("t", 7, 6, 1.0, "u", "cycle")]
    m = spark.createDataFrame(rows, "tree string, msg long, parent long, score double, role string, text string")
    best = chat_format.format_chats(m).collect()
    assert [chat_format.parse_turns(r.formatted) for r in best] == [[("user", "q"), ("assistant", "good"), ("user", "")]]
    two = chat_format.format_chats(m, top=2).collect()
    assert sorted(r.leaf for r in two) == [2, 4] or sorted(r.leaf for r in two) == [4, 5]
    deep = spark.createDataFrame([("d", k, k - 1 if k else None, 0.0, "u", str(k)) for k in range(70)], m.schema)
    assert [t for _, t in chat_format.parse_turns(chat_format.format_chats(deep).first().formatted)] == [str(k) for k in range(70)]
    assert chat_format.format_chats(m.limit(0)).count() == 0


def test_flat_conversations(spark):
    c = spark.createDataFrame([(1, 2, "assistant", None), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, None, None, "x")], "conv_id long, turn long, role string, text string")
    got = {r.tree: chat_format.parse_turns(r.formatted) for r in chat_format.format_chats(chat_format.thread_of(c)).collect()}
    assert got == {"1": [("user", "a"), ("user", "a"), ("assistant", "")], None: [("", "x")]}


def test_odd_messages(spark):
    """No tree, no msg, repeated and differing messages, clashing columns, long texts and many turns."""
    long = "a\\ ### </turn> : <" * 100_000
    rows = [(None, 1, None, None, "user", "q", "x"), (None, 2, 1, 1.0, None, long, "x"), ("t", 1, None, 0.0, "user", "b", "x"), ("t", 1, None, 0.0, "user", "a", "y"), ("t", None, 1, 9.0, "user", "lost", "x")]
    rows += [("t", 2, 1, 0.5, "assistant", "same", "x")] * 4 + [("", 5, None, 0.0, "u:", "", "x"), ("t", 3, 1, 0.5, "assistant", "as good", "x")]
    m = spark.createDataFrame(rows, "tree string, msg long, parent long, score double, role string, text string, pos string").withColumns({"leaf": F.lit(1), "up": F.lit(2), "depth": F.lit(3)})
    got = {r.tree: chat_format.parse_turns(r.formatted) for r in chat_format.format_chats(m).collect()}
    assert got == {None: [("user", "q"), ("", long)], "t": [("user", "a"), ("assistant", "same")], "": [("u:", "")]}


def test_broken_turns():
    for x in ("### a: b", "### a b </turn>\n", "a: b </turn>\n", "### a: b</turn>\n", "### a: \\</turn>\n", "### a: b </turn>"):
        with pytest.raises(ValueError):
            chat_format.parse_turns(x)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe(make_docs, odd_rows, name):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    t = Tokenizer.from_file(path)
    rows = [*odd_rows, (40, "it's <|endoftext|> Éé ß İ 漢字   " * 40)]
    got = bpe.decode(bpe.encode(make_docs(rows), path, piece=100), path).collect()
    want = Counter((i, tuple(ids := t.encode(x or "", add_special_tokens=False).ids), t.decode(ids, skip_special_tokens=False)) for i, x in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    at_once = bpe.encode(make_docs(rows), path, piece=100, decoded=True).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in at_once) == want
    empty = bpe.decode(bpe.encode(make_docs(rows).limit(0), path), path)
    assert empty.columns == ["doc_id", "ids", "decoded"] and empty.count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_joins(name):
    from tokenizers import Tokenizer

    spec = open(queries.tokenizer_path(name)).read()
    tool, plain, rng = bpe.coder(spec), Tokenizer.from_str(spec), random.Random(1)
    assert tool.space_bound == (name == "word_bpe_49k.json")
    alphabet = ["a", "the", "'", "s", "S", "é", "é", "́", " ", "\n", " ", "ß", "İ", "1", "<|endoftext|>", "<|", "!!", "漢", "x" * 9, "  ", "'t"]
    for k in range(1500):
        x = "".join(rng.choices(alphabet, k=rng.randint(0, 60 if k % 3 else 700)))
        n = rng.choice([1, 2, 5, 17, 90])
        parts = [x[k : k + n] for k in range(0, len(x), n)] or [""]
        assert bpe.join_tree(tool, [tool.piece(p) for p in parts]).ids.tolist() == plain.encode(x, add_special_tokens=False).ids


def test_bpe_memory_is_bounded():
    tool = bpe.Coder(open(queries.tokenizer_path()).read())
    tool.room, texts = 5_000, [" ".join(f"w{k}x{j}" for j in range(50)).encode() for k in range(40)]
    first = tool.encode_many(texts)
    assert 0 <= tool.room and 0 < len(tool.known) < 50 and tool.encode_many(texts) == first


def test_search_is_exhaustive():
    """Block-max WAND returns just the items that scoring every item returns."""
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(5, 40)))) for k in range(150)]
    index = decontaminate.Index(items)
    import numpy as np

    for _ in range(150):
        own = np.array(sorted({index.term[w] for w in (x.encode() for x in rng.choices(words, k=60)) if w in index.term}))
        scores = [sum(p.weights[p.items.index(k)] for p in (index.postings[t] for t in own) if k in p.items) for k in range(len(index.ids))]
        assert sorted(k for k, _ in index.search(own, 0.2)) == [k for k, s in enumerate(scores) if s >= 0.2]


def test_decontaminate(spark, make_docs):
    items = [(1, "What is the tallest mountain of the whole wide world?\nIt is Mount Everest in Nepal."), (2, None), (3, ""), (1, "What is the tallest mountain of the whole wide world?\nIt is Mount Everest in Nepal.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = items[0][1]
    filler = " ".join(f"f{k}" for k in range(500))
    rows = [(1, f"{filler} {text.upper()} {filler}"), (2, text.replace("\n", "   ")), (3, filler), (4, None), (5, ""), (6, "What is the tallest mountain"), (7, text), (7, text)]
    got = decontaminate.decontaminate(make_docs(rows), bench).collect()
    assert Counter((r.doc_id, r.contaminated) for r in got) == Counter([(1, True), (2, True), (3, False), (4, False), (5, False), (6, False), (7, True), (7, True)])
    kept = decontaminate.keep_clean(make_docs(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.decontaminate(make_docs(rows), bench.limit(0)).filter("contaminated").count() == 0


def brute_decontaminate(items, rows, least=0.6, overlap=0.8):
    """Every passage against every item, with BM25 scores from the formula."""
    parts = [(i, *map(decontaminate.folded_words, decontaminate.question_answer(t or ""))) for i, t in items]
    parts = [p for p in parts if p[1] or p[2]]
    bags = [Counter(q + a) for _, q, a in parts]
    mean = sum(sum(b.values()) for b in bags) / max(1, len(bags))
    step = max((sum(b.values()) for b in bags), default=1)
    idf = lambda t: math.log(1 + (len(bags) - sum(t in b for b in bags) + 0.5) / (sum(t in b for b in bags) + 0.5))
    weights = [{t: idf(t) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t, n in b.items()} for b in bags]
    windows = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    out = Counter()
    for i, t in rows:
        words = decontaminate.folded_words(t or "")
        found = set()
        for start in range(0, max(1, len(words) - step), step):
            passage = words[start : start + 2 * step]
            for (item, q, a), w in zip(parts, weights):
                shares = [len(windows(x, min(5, len(x))) & windows(passage, min(5, len(x)))) / max(1, len(windows(x, min(5, len(x))))) if x else 1 for x in (q, a)]
                if sum(w[x] for x in set(passage) if x in w) / sum(w.values()) >= least and min(shares) >= overlap:
                    found.add(item)
        out[i, tuple(sorted(found))] += 1
    return out


@pytest.mark.parametrize("shard", [1 << 22, 400])
def test_decontaminate_brute(spark, make_docs, odd_rows, monkeypatch, shard):
    """With items of one index and of several shards; whole, cut, mixed and long passages."""
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(60)]
    words = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, f"{words(rng.randint(4, 20))}? {words(rng.choice([0, 1, 3, 9]))}".strip()) for k in range(40)]
    items += [(41, None), (42, " "), (43, "one"), (None, words(9))]
    rows = list(odd_rows)
    for k in range(90):
        q, a = decontaminate.question_answer(rng.choice(items[:40])[1])
        kind = k % 6
        text = [q + a, q, a, f"{q} {words(3)} {a}", f"{q} {words(200)} {a}", words(50)][kind]
        if k % 4 == 3:
            w = text.split()
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        rows.append((100 + k, f"{words(rng.randint(0, 90))} {text}, {words(rng.randint(0, 90))}"))
    rows += [rows[20]] * 2
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = decontaminate.decontaminate(make_docs(rows), bench).collect()
    assert Counter((r.doc_id, tuple(sorted({x.item_id for x in r.items}))) for r in got) == brute_decontaminate(items, rows)
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)
    kept = Counter(r.doc_id for r in decontaminate.keep_clean(make_docs(rows), bench).collect())
    assert kept == Counter(r.doc_id for r in got if not r.contaminated)
    assert decontaminate.decontaminate(make_docs([]).limit(0), bench).count() == 0


def test_question_without_answer(spark, make_docs):
    bench = spark.createDataFrame([(1, "What is the name of the tallest mountain in the world? Everest")], "item_id long, text string")
    q = bench.first().text.rsplit(" ", 1)[0]
    got = decontaminate.decontaminate(make_docs([(1, f"{q} Nobody knows"), (2, f"{q} Everest")]), bench).collect()
    assert {r.doc_id: r.contaminated for r in got} == {1: False, 2: True}


def test_quality_held_out(spark):
    """On documents whose labels training didn't see."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.classify(docs, labels.filter("doc_id % 3 <> 0")).join(labels.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    assert len(scored) > 100
    assert ((scored.p_quality >= 0.5) == (scored.quality > 0)).mean() > 0.93
    assert ((scored.p_toxic >= 0.5) == (scored.toxic > 0)).mean() > 0.93
    for found, true in ((scored.p_quality < 0.5, scored.quality == 0), (scored.p_toxic >= 0.5, scored.toxic > 0)):  # more than the commoner answer gives
        assert (true & found).sum() >= 0.9 * found.sum() and (true & found).sum() >= 0.6 * true.sum() > 0


def test_quality_edges(spark, make_docs, odd_rows):
    none = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    docs = make_docs(odd_rows)
    assert quality.classify(docs, none).filter("kept").count() == len(odd_rows)
    assert quality.keep_good(docs, none.limit(0)).columns == docs.columns
    assert quality.classify(docs.limit(0), none).count() == 0


def test_quality_learns_from_all_unlabelled(spark):
    """Also where those with the 2,000 smallest hashes have labels, and repeated ids count once."""
    rng = random.Random(5)
    words = ["fine words of a good page", "buy junk now cheap deal"]
    rows = [(k, " ".join(rng.choices(words[k % 2].split(), k=30)), "en", "s", 1) for k in range(2600)]
    docs = spark.createDataFrame(rows + rows[:900], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    first = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("pool")), "doc_id").limit(2000)
    labels = first.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = quality.train(docs, labels)
    assert got["toxic"] is None and got["quality"].handed > quality.HANDED


def test_quality_surest(spark):
    rng = random.Random(6)
    rows = [(k % 900, [rng.randrange(20) for _ in range(rng.randint(0, 9))], [k % 900]) for k in range(1200)]
    rows = [rows[k % 900] for k in range(1200)]
    free = spark.createDataFrame(rows, "doc_id long, quality0 array<int>, quality1 array<int>").repartition(4)
    import numpy as np

    w = np.array([rng.uniform(-3, 3) for _ in range(21)], dtype=np.float32)
    p = {i: 1 / (1 + np.exp(-(sum(float(w[c]) for c in a) + float(w[-1])))) for i, a, _ in rows}
    best = sorted((i for i in p if i % 7 and abs(p[i] - 0.5) >= quality.SURE - 0.5), key=lambda i: -abs(p[i] - 0.5))[: quality.HANDED]
    got = quality._draw(free, "quality")(0, w, {i for i in p if i % 7 == 0})
    assert len(got) == len({i for i, _, _ in got}) == len(best) and all(c == [i] for i, _, c in got)
    assert np.allclose(sorted(abs(q - 0.5) for _, q, _ in got), sorted(abs(p[i] - 0.5) for i in best), atol=1e-6)


def test_quality_scores_recomputed(spark, make_docs, odd_rows):
    """Every score again from the models' weights, without the operator's own sums; nulls, repeated and very long rows among them."""
    rng = random.Random(11)
    good, bad, rude = ("fine useful page about science".split(), "buy cheap junk now click".split(), "awful hateful words".split())
    taught = [(1000 + k, " ".join(rng.choices(bad if k % 2 else good, k=rng.randint(3, 30)) + (rng.choices(rude, k=3) if k % 5 == 0 else []))) for k in range(300)]
    labels = spark.createDataFrame([(i, int("junk" not in t and "buy" not in t), int("hateful" in t)) for i, t in taught] + [(None, 1, 0), (1000, None, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs(taught + odd_rows)
    narrow = docs.select("doc_id", "text", "lang", "source", "n_chars")
    models = quality.train(narrow, labels)
    got = quality.classify(docs, labels).collect()

    def plain(m, text, lang, source, n):
        numbers, words = quality.text_view(text)
        z = []
        for view, w, part, (slope, offset) in ((m.text, m.text_w, (numbers, words), m.calibration[0]), (m.meta, m.meta_w, ([], quality.meta_view(lang, source, n)), m.calibration[1])):
            x, at = [0.0] * view.width, 0
            for edges, v in zip(view.edges, part[0]):
                x[at + sum(v >= e for e in edges)] = 1.0
                at += len(edges) + 1
            for h in set(part[1]):
                if h in view.columns:
                    x[view.columns[h]] = 1.0
            z.append(slope * (sum(a * b for a, b in zip(x, w)) + w[-1]) + offset)
        return 1 / (1 + math.exp(-(z[0] * m.mix[0] + z[1] * m.mix[1] + m.mix[2])))

    want = Counter((r.doc_id, *(round(plain(models[t], r.text, r.lang, r.source, r.n_chars), 4) for t in quality.TARGETS)) for r in narrow.collect())
    have = Counter((r.doc_id, round(r.p_quality, 4), round(r.p_toxic, 4)) for r in got)
    assert have == want and len(got) == len(taught) + len(odd_rows)
    assert all(r.kept == (r.p_quality >= 0.5 and r.p_toxic < 0.5) for r in got)
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_sharding(spark, tmp_path):
    names = [f"s{k}" for k in range(10)]
    table = sharding.fill_table(names, 1009)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    less = sharding.fill_table(names[:9], 1009)
    moved = sum(a != b for a, b in zip(table, less) if a != 9)
    assert moved < 0.25 * 1009
    weighted = Counter(sharding.fill_table(["a", "b"], 1009, {"a": 3}))
    assert abs(weighted[0] / weighted[1] - 3) < 0.05
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)
    rows = spark.createDataFrame([(k % 500, "x", "y") for k in range(1000)] + [(None, "x", "y")], "doc_id long, slot string, shard string")
    placed = sharding.place(rows, "doc_id", names, 1009).collect()
    assert len(placed) == 1001 and all(r.shard == names[table[r.slot]] for r in placed)
    assert len({(r.doc_id, r.shard) for r in placed}) == 501
    sharding.write_shards(rows, "doc_id", f"file://{tmp_path}/out", names, 2, 1009)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1001
    # A key's slot, found without Spark.
    for r in placed:
        if r.doc_id is not None:
            assert r.slot == _signed(xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)) % 1009


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("key", ["slot", "shard", "_part", "doc_id"])
def test_sharding_clashes(spark, tmp_path, key):
    """Keys and columns that are named like the operator's own; an empty table."""
    rows = spark.createDataFrame([(k, f"s{k}", f"h{k}", f"p{k}") for k in range(50)], "doc_id long, slot string, shard string, _part string")
    names = ["a", "b"]
    placed = sharding.place(rows, key, names, 1009).collect()
    assert len(placed) == 50 and {r.shard for r in placed} == {"a", "b"}
    out = f"file://{tmp_path}/out"
    sharding.write_shards(rows, key, out, names, 2, 1009)
    back = spark.read.parquet(out)
    assert sorted(back.columns) == ["_part", "doc_id", "shard", "shard_", "slot"]
    assert {(r.doc_id, r.slot, r.shard_, r._part) for r in back.collect()} == {tuple(r) for r in rows.collect()}
    assert sharding.place(rows.limit(0), key, names, 1009).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="page"><header><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav>
<div class="cookie-notice">We use cookies, accept them all, please do.</div><div id="content"><h2>Head &amp; line</h2><p>First   paragraph, with a <a href="#">link</a>.<p>Second&nbsp;one; it is longer, much longer, than the others are.
<div class="ad">Buy this, now, today.</div><ul><li>item one<li>item two</ul><p>caf&eacute;<br>break <script>var x = "</p>";</script>end.</div>
<aside>Related, read more.</aside><form>Sign up</form><div class="comments"><p>I disagree, strongly, with all of this, and here is a long reason why.</p></div><footer>&copy; us</footer></body></html>"""


def test_extract(spark):
    want = "Head & line\nFirst paragraph, with a link.\nSecond one; it is longer, much longer, than the others are.\nitem one\nitem two\ncafé break end."
    assert html_extract.extract(PAGE) == want
    for odd in ("", "   ", "<", "<p", "<!-- x", "<script>", "</p>", "<html></html>", "&amp", "a < b"):
        html_extract.extract(odd)
    assert html_extract.extract("just text") == "just text"
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(rows).collect()
    assert Counter((r.page_id, r.url, r.text) for r in got) == Counter([(1, "u", want), (1, "u", want), (2, None, ""), (None, "v", "")])


BODY = "<h2 id='Related_work'>Related work</h2><p>The first paragraph, which is long, says something.</p><section id='search-algorithms'><p>A second one, about search, is long as well.</p></section>"
BODY_TEXT = "Related work\nThe first paragraph, which is long, says something.\nA second one, about search, is long as well."


@pytest.mark.parametrize(
    "page",
    [
        "<body><article>{}</article></body>", "<body><div class='content with-sidebar'><article>{}</article></div></body>", "<body><div class='post has-comments'>{}</div></body>",
        "<body><form id='aspnetForm'><div class='page'>{}</div></form></body>", "<body><form><main>{}</main></form></body>", "<body><div class='widget'><article>{}</article></div></body>",
        "<body><div class='sidebar'><div>{}</div></div></body>", "<body><aside><article>{}</article></aside></body>", "<html><head><meta charset=utf-8><title>T</title><body><div>{}</div></body></html>",
    ],
)
def test_extract_marks_are_hints(page):
    chrome = "<nav><a>Home</a></nav><div class='site-footer'>Imprint, privacy.</div>"
    assert html_extract.extract(page.format(BODY)) == BODY_TEXT
    assert html_extract.extract(page.format(BODY).replace("</body>", chrome + "</body>")) == BODY_TEXT


def test_extract_marks_that_hold():
    long = "<p>I disagree, strongly, with all of this, and here is a long reason why.</p>" * 9
    for away in (f"<div id='comments' class='comments-area'><article class='comment'>{long}</article></div>", f"<aside><article>{long}</article></aside>", f"<div class='ad'>{long}</div>", f"<nav> <b>{long}</b> </nav>"):
        assert html_extract.extract(f"<body><article>{BODY}</article>{away}</body>") == BODY_TEXT


AWAY = ["user-comments", "comment-thread", "post-comments", "disqus_thread", "discussion", "ad-slot", "google-ad", "advert-300x250", "share-buttons", "related-posts", "nav-links", "cookie-message", "comments", "ad-container", "readerComments", "comment-list__item"]
PROSE = "<p>I disagree, strongly, with all of this, and here is a long reason why.</p>"


@pytest.mark.parametrize("name", AWAY)
@pytest.mark.parametrize("text", ["<p>Nice, thanks.</p>", PROSE, PROSE * 2, "plain"])
def test_extract_marked_parts_go(name, text):
    """Comments, adverts and the like go inside and outside an article, whatever their length; nothing of the article does."""
    part = f"<div class='{name}'>{text}</div>"
    for page in (f"<article>{BODY}{part}</article>", f"<article>{BODY}</article>{part}", f"<main><article>{part}{BODY}</article></main>", f"<main>{part}<article>{BODY}</article></main>", f"<div class='post'>{BODY}{PROSE * 3}</div>{part}"):
        assert html_extract.extract(f"<body>{page}</body>") == BODY_TEXT + ("\n" + PROSE[3:-4]) * 3 * ("post'>" in page)


def test_extract_doubts():
    """A class with a word that may mean something else is settled by links and ratios; dated records without any class are comments."""
    prose, links = PROSE * 3, "<a href=x>One of many</a> <a href=y>Two of them</a>"
    kept = BODY_TEXT + ("\n" + PROSE[3:-4]) * 3
    for name in ("market-share-table", "cookie-recipe", "ad-hoc-analysis", "social-history", "has-comments", "no-sidebar"):
        assert html_extract.extract(f"<body><article>{BODY}<div class='{name}'>{prose}</div></article></body>") == kept
    for name in ("share-this-page", "related-by-topic", "popular-tags-menu"):
        assert html_extract.extract(f"<body><article>{BODY}<div class='{name}'>{links}</div></article></body>") == BODY_TEXT
    assert html_extract.extract(f"<body><article>{BODY}<section id='discussion'>{prose}</section></article></body>") == kept
    record = "<div><b class='author'>Ann</b> <time>3 May</time><p>I disagree, for one, and say so.</p></div>"
    assert html_extract.extract(f"<body><article>{BODY}{prose}</article><div>{record * 4}</div></body>") == kept
    assert html_extract.extract(f"<body><div>{BODY}{prose * 4}</div><div>{record * 3}</div></body>").endswith(PROSE[3:-4])
    assert "I disagree, for one" in html_extract.extract(f"<body><article>{BODY}{record * 4}</article></body>")


def brute_selected(page):
    """Selected texts by path ratios, from another parser and plain sums."""
    from html.parser import HTMLParser

    found = []

    class Walk(HTMLParser):
        stack: list = []

        def handle_starttag(self, tag, attrs):
            self.stack = [*self.stack, tag]

        def handle_endtag(self, tag):
            self.stack = self.stack[:-1]

        def handle_data(self, data):
            if data.strip():
                found.append((tuple(self.stack), " ".join(data.split())))

    Walk().feed(page)
    n = len(found)
    ratio = lambda f: [sum(f(t) for p, t in found if p == q) / sum(p == q for p, _ in found) for q, _ in found]

    def smooth(x):
        w = lambda i, j: math.exp(-((i - j) ** 2) / 2) * (abs(i - j) <= 2)
        return [sum(w(i, j) * x[j] for j in range(n)) / sum(w(i, j) for j in range(n)) for i in range(n)]

    fused = [a * (1 + b) for a, b in zip(smooth(ratio(len)), smooth(ratio(lambda t: sum(c in ".,;:!?。，、؛؟…" for c in t))))]
    mean = sum(fused) / n
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused) / n)
    return [(t, x >= (min(mean, 0.8 * spread) if spread else mean)) for (_, t), x in zip(found, fused)]


def test_extract_ratios_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        part = lambda: rng.choice(["<div><span>{}</span></div>", "<div>{}</div>", "<section><b>{}</b><i>x</i></section>", "<div><div><em>{}</em></div></div>"]).format(rng.choice(["Home", "A sentence, of some length, with marks. " * rng.randint(1, 6), "a b c"]))
        page = "<html><body>" + "".join(part() for _ in range(rng.randint(1, 25))) + "</body></html>"
        _, nodes = html_extract.parse(page)
        texts = [(node, " ".join(t.split())) for node, t in nodes if t and t.strip()]
        assert list(zip((t for _, t in texts), html_extract.content_nodes(texts))) == brute_selected(page)


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ("<svg class='icon' />", ""), ("<svg width=1/><p>More.</p><svg><text>x</text></svg>", "\nMore."), ("<svg><title/><script/><style/><path d='M0'/></svg><p>More.</p>", "\nMore."),
        ("<svg class=icon><path d='M0'><p>More.</p>", "\nMore."), ("<math/><p>More.</p>", "\nMore."), ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p>", "\nSo x=1."),
        ("<iframe src='x' /><p>More.</p><iframe></iframe>", "\nMore."), ("<iframe src='x'><p>More.</p>", "\nMore."), ("<p>So <noscript><div>No scripts</div></noscript>on.</p>", "\nSo on."),
        ("<ul><li>So <template><li>gone</li></template>on.</ul>", "\nSo on."), ("<div><template shadowrootmode=open><p>More.</p></template></div>", "\nMore."),
        ("<xmp><b>More</b> &lt;</xmp>", "\n<b>More</b> &lt;"), ("<script>a</script ><style>b</style x><p>More.</p>", "\nMore."),
    ],
)
def test_extract_raw_and_foreign(inside, want):
    assert html_extract.extract(f"<body><article>{BODY}{inside}</article></body>") == BODY_TEXT + want
    assert html_extract.extract(f"<body>{inside}<article>{BODY}</article></body>").endswith(BODY_TEXT)


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "text, here. " * 50, "<div>" * 20_000 + "text, here. " * 50, "<i>x, y. " * 20_000, "<div><p>x, y. " * 20_000, "<ul><li>x, y. " * 10_000, '<p title="x>y, z. ' * 3_000])
def test_extract_deep(page):
    """Time and memory go with a page's length, whatever its depth."""
    start = time.process_time()
    found = html_extract.extract(page)
    assert time.process_time() - start < 10 and "<" not in found and ", " in found


def test_extract_torn_tag():
    assert html_extract.extract(f'<body><article><p title="x>Torn, but read. </p>{BODY}</article></body>') == "Torn, but read.\n" + BODY_TEXT
    assert html_extract.extract(f"<body><article>{BODY}<p>A long text, 10 MB of it. {'Word, word. ' * 900_000}</p></article></body>").startswith(BODY_TEXT)


def test_extract_page_in_noscript():
    for tag in ("noscript", "noframes", "template"):
        assert html_extract.extract(f"<body><{tag}><div>{BODY}</div></{tag}></body>") == BODY_TEXT


def test_extract_all_selected():
    """Selected text outside the element that holds most of it, with its section; unselected text there isn't the article's."""
    line, far = "This sentence, one of many, is as long as those of an article are.", "<div><a>Home</a></div>" * 9
    long, end = f"<p>{line}</p>" * 30, f"<h2>End</h2><p>{line}</p>"
    for first, last in (
        (f"<div>{long}</div>", f"<div>{end}<ul><li>a</ul></div>"), (f"<div><div>{long}</div></div>", f"<section>{end}</section>"), (f"<article>{long}</article>", f"<article>{end}<div>a</div></article>"),
        (f"<main>{long}</main>", f"<div>{end}</div>"), (f"<article>{long}</article>", f"<div>{end}<ol><li>a</ol></div>"),
    ):
        tail = ["End", line, "a"] if ">a<" in last else ["End", line]
        assert html_extract.extract(f"<body>{first}{last}</body>").split("\n") == [line] * 30 + tail
        assert html_extract.extract(f"<body>{last}{first}</body>").split("\n") == tail + [line] * 30
    assert html_extract.extract(f"<body>{line}<div>{long}</div>{line}</body>").split("\n") == [line] * 32
    assert "Home" not in html_extract.extract(f"<body>{far}<div>{long}</div></body>")


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    last = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, last, SMALL)
        assert sorted(kept.columns) == sorted(docs.columns)
        assert kept.count() <= last.count() and kept.join(docs, "doc_id", "left_anti").count() == 0
        last = kept
    out = corpus_pipeline.run(spark, SMALL)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in last.select("doc_id").collect())


def kept_of(stage, spark, docs, sf_dir="unused"):
    return Counter((r.doc_id, r.text) for r in stage(spark, docs, sf_dir).select("doc_id", "text").collect())


def test_pipeline_shared_and_null_ids(spark, make_docs):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, a), (5, b), (3, b), (None, c), (None, c), (None, a), (None, None), (8, "")]
    assert kept_of(corpus_pipeline.exact_deduplication, spark, make_docs(rows)) == Counter([(5, a), (3, b), (None, c), (8, "")])
    near = [(5, a), (5, a), (5, b), (3, b + " end"), (None, c), (None, c + " end"), (None, "end " + a)]
    got = kept_of(corpus_pipeline.near_deduplication, spark, make_docs(near))
    assert got in (Counter([(5, a), (3, b + " end"), (None, c)]), Counter([(5, a), (3, b + " end"), (None, c + " end")]))


def first_of_groups(rows, linked):
    """Brute force: one row of each component of ``linked`` rows, that of the smallest id (null last)."""
    left, out = list(rows), []
    while left:
        group = [left.pop(0)]
        for x in group:
            group += [y for y in left if linked(x[1], y[1])]
            left = [y for y in left if not linked(x[1], y[1])]
        out.append(min(group, key=lambda r: (r[0] is None, r[0] or 0)))
    return Counter(out)


def test_pipeline_stages_by_brute_force(spark, make_docs, odd_rows, tmp_path):
    """The rows that each filtering stage keeps, with nulls, empty texts, repeated rows and clashing column names."""
    import corpus_pipeline as p

    item = "what is the tallest mountain of the whole wide world it is mount everest in nepal"
    filler = " ".join(f"f{k}" for k in range(80))
    extra = [(30, filler), (31, filler + " more"), (32, f"{filler[:150]} {item} {filler[150:]}"), (33, item), (33, item), (34, "the tallest mountain"), (None, item), (35, filler.replace(" ", "  ")), (30, filler)]
    rows = odd_rows + extra
    docs, where = make_docs(rows), f"file://{tmp_path}"
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    good, bad = "a fine page about many useful things", "buy junk now cheap deal click"
    taught = [(1000 + k, f"{(good, bad)[k % 2]} {k % 7}") for k in range(200)]
    spark.createDataFrame([(i, int(x.startswith(good)), 0) for i, x in taught], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")

    def same(x, y):
        return re.sub(r"[ \t\n]+", " ", x or "") == re.sub(r"[ \t\n]+", " ", y or "")

    assert kept_of(p.exact_deduplication, spark, docs) == first_of_groups(rows, same)

    def shingles(x):
        w = (x or "").lower().split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def near(x, y):
        a, b = shingles(x), shingles(y)
        return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)

    got = kept_of(p.near_deduplication, spark, docs)
    assert Counter(i for i, _ in got.elements()) == Counter(i for i, _ in first_of_groups(rows, near).elements())

    clean = Counter(r for r in rows if item not in " ".join((r[1] or "").lower().split()))
    assert kept_of(p.benchmark_decontamination, spark, docs, where) == clean

    mixed = taught + [(None, good), (None, bad), (2000, good), (2000, bad), (2000, bad)]
    kept = kept_of(p.quality_classifier, spark, make_docs(mixed), where)
    assert kept == Counter(r for r in mixed if r[1].startswith(good))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    from pathlib import Path

    import duckdb

    c = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    got = queries.QUERIES[name](spark, SMALL)
    cur = c.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    order = {x: k for k, x in enumerate(columns)}
    assert Counter(tuple(r[x] for x in columns) for r in got.collect()) == Counter(tuple(r[order[x]] for x in columns) for r in cur.fetchall())


def test_all_queries_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert F is not None


def test_pipeline_gives_memory_back(spark, monkeypatch):
    """Executors collect garbage before each stage, and the classifier's ids take no Python workers."""
    import corpus_pipeline as p
    from pyspark import SparkContext
    from tidelog.llm.common import give_back

    give_back(spark)

    def stop(*args, **more):
        raise InterruptedError

    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    monkeypatch.setattr(p, "give_back", stop)
    for _, stage in p.STAGES:
        with pytest.raises(InterruptedError):
            stage(spark, docs, SMALL)
    monkeypatch.setattr(SparkContext, "parallelize", stop)
    assert any(quality.train(docs, labels).values())
