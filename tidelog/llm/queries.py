"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, exact_dedup, html_extract, importance, line_dedup, merkle, near_dedup, quality, sharding, substring_dedup, url_filter
from .common import read_table

TOKENIZER = "word_bpe_49k.json"
#: A conversation that tries the chat template's own control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"
#: The rules of op11.
RULES = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"), url_filter.Rule("example.com", "/de/", "block"), url_filter.Rule("org", "/fr/", "allow")]
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns", pa.string()), ("loss", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            turns = chat_format.parse_turns(r["formatted"])
            loss = "".join(chat_format.unescape(r["formatted"][m["start"] : m["end"]]) for m in r["mask"])
            rows.append({"conv_id": int(r["tree"]) if r["tree"] else None, "n_turns": len(turns), "turns": "".join(f"{a}\n{b}\n" for a, b in turns), "loss": loss, "formatted_chars": len(r["formatted"])})
        yield pa.RecordBatch.from_pylist(rows, schema)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(chat_format.thread_of(conversations.unionByName(probe)))
    back = chats.mapInArrow(_read_back, "conv_id long, n_turns long, turns string, loss string, formatted_chars long")
    return back.select("conv_id", "n_turns", sha256_hex(F.col("turns")).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha256_hex(F.col("loss")).alias("loss_sha256"), "formatted_chars")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"), width=50)
    return cut.select("doc_id", "n_words", "n_removed", sha256_hex(F.col("text")).alias("kept_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(read_table(spark, sf_dir, "documents"), width=4, percent=80)


def bpe_digests(docs: DataFrame, *keep: str, remembered: int = bpe.REMEMBERED_BYTES) -> DataFrame:
    coded = bpe.encode(docs, tokenizer_path(), decoded=True, remembered=remembered)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_hex(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256"), *keep)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.size("items").cast("long").alias("n_items"), F.col("items.item_id").alias("item_ids"), "n_passages")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs, min_chars=40, min_docs=5))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(read_table(spark, sf_dir, "documents"), "doc_id", SHARDS)
    return placed.select("doc_id", "slot", "shard", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))  # whole documents are placed


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=10, longest=1, buckets=10_000, seed=2024, least_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    seen = F.when(tampered, merkle.leaf_digest(*fields(F.col("n_chars").cast("decimal(20,0)") + 1)))  # what a reader of the tampered table sees
    proven = merkle.manifest(docs, merkle.leaf_digest(*fields(F.col("n_chars"))), "lang", ["doc_id"], carry={"seen": seen})
    checked = merkle.folded(proven.withColumn("seen", F.coalesce("seen", "digest")), "seen")
    text = lambda c: F.lower(F.hex(c))
    return checked.select("doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"), "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_format, op2_exact_dedup, op3_substring_dedup, op4_near_dedup, op5_bpe, op6_decontaminate, op7_line_dedup, op8_quality, op9_sharding, op10_html_extract, op11_url_filter, op12_importance, op13_merkle)
}

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_ESCAPED = r"regexp_replace({}, '(\\|###|</turn>|: )', '_\1', 'g')"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LINK = url_filter.LINK.replace("'", "''")
_HOST, _PATH = "regexp_extract({}, '://([^/?#]*)', 1)", "regexp_extract({}, '://[^/?#]*([^?#]*)', 1)"


_BYTES = "list_transform(range(1, length(hex(encode({0}))), 2), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(i AS INTEGER), 2) AS BIGINT))"
_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n))"
_CRC = f"xor(list_reduce({_BYTES}, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"
_FIELDS = "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"


def _rounds_sql() -> str:
    """The propagation of op11, one common table a round."""
    kept, passed = 1000 - url_filter.PASSED, url_filter.PASSED
    out = [f"s0 AS MATERIALIZED (SELECT kind, host, CAST(floor(seed * {kept} / 1000) AS BIGINT) AS own, CAST(floor(seed * {kept} / 1000) AS BIGINT) AS score FROM seeds)"]
    for k in range(url_filter.ROUNDS):
        got = f"SELECT e.kind, e.dst AS host, sum(CAST(floor(CAST(s.score AS DOUBLE) * e.n / e.total) AS BIGINT)) AS got FROM edges e JOIN s{k} s ON s.kind = e.kind AND s.host = e.src GROUP BY ALL"
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT s.kind, s.host, own, own + CAST(floor(CAST(coalesce(got, 0) AS DOUBLE) * {passed} / 1000) AS BIGINT) AS score FROM s{k} s LEFT JOIN ({got}) g ON g.kind = s.kind AND g.host = s.host)")
    return ",\n".join(out)


def _rule_sql(verdict: bool) -> str:
    """The longest rule that fits, or its verdict, from host and path."""
    longest = sorted(RULES, key=lambda r: (-len(r.name), -len(r.host)))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') THEN '{r.verdict if verdict else r.name}'" for r in longest) + " END"


ORACLES: dict[str, str] = {
    "op1_chat_format": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
chats AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(15 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM chats""",
    "op2_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)""",
    "op3_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, words FROM w),
s AS (SELECT doc_id, i, words[i] AS word, CASE WHEN i + 49 <= len(words) THEN md5(array_to_string(words[i : i + 49], ' ')) END AS win FROM p),
f AS (SELECT win, min(doc_id) AS low FROM s WHERE win IS NOT NULL GROUP BY win),
m AS (SELECT s.doc_id, s.i, s.word, CASE WHEN f.low < s.doc_id THEN s.i END AS hit FROM s LEFT JOIN f ON s.win = f.win),
c AS (SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NULL AS keep FROM m),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op4_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, least(len(words), 1)) + 1)) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS sh FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * same >= 80 * (na.n + nb.n - same)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.i, k.line, f.last IS NOT NULL AND f.last <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op11_url_filter": rf"""
WITH u AS (SELECT page_id, {_LOWER.format(_HOST.format("coalesce(url, '')"))} AS host, {_PATH.format("coalesce(url, '')")} AS path, html FROM pages),
l AS (SELECT host AS src, ':' || unnest(regexp_extract_all(coalesce(html, ''), '{_LINK}', 1)) AS x FROM u),
t AS (SELECT src, {_LOWER.format(_HOST.format("x"))} AS host, {_PATH.format("x")} AS path FROM l),
links AS (SELECT * FROM t WHERE src <> '' AND host <> ''),
urls AS (SELECT page_id, host, path, {_rule_sql(False)} AS rule, {_rule_sql(True)} AS v FROM u),
seen AS (SELECT host, v FROM urls UNION ALL SELECT host, {_rule_sql(True)} FROM links),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE v = 'allow') AS allowed, count(*) FILTER (WHERE v = 'block') AS barred FROM seen GROUP BY host),
seeds AS (
  SELECT 'trust' AS kind, host, CAST(floor(CAST(allowed AS DOUBLE) * {url_filter.UNIT} / n) AS BIGINT) AS seed FROM hosts
  UNION ALL SELECT 'distrust', host, CAST(floor(CAST(barred AS DOUBLE) * {url_filter.UNIT} / n) AS BIGINT) FROM hosts),
pairs AS (SELECT src, host AS dst, count(*) AS n FROM links WHERE src <> host GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM pairs UNION ALL SELECT 'distrust', dst, src, n FROM pairs),
edges AS (SELECT *, sum(n) OVER (PARTITION BY kind, src) AS total FROM both_ways),
{_rounds_sql()},
bad AS (
  SELECT host FROM s{url_filter.ROUNDS} GROUP BY host
  HAVING sum(score) FILTER (WHERE kind = 'distrust') >= {url_filter.LEAST} AND sum(score) FILTER (WHERE kind = 'distrust') > sum(score) FILTER (WHERE kind = 'trust'))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM urls""",
    "op12_importance": rf"""
WITH tab AS (SELECT {_TABLE} AS tab),
w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
d AS (SELECT row_number() OVER () AS k, doc_id, words FROM w),
o AS (SELECT k, unnest(words) AS word FROM d),
b AS (SELECT unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM o UNION SELECT word FROM b)),
y AS (SELECT word, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, CAST(i AS INTEGER), 2) AS BIGINT)) AS bytes FROM v),
c AS (SELECT word, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM y, tab),
s AS (SELECT bucket, count(*) AS s FROM o JOIN c USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN c USING (word) GROUP BY bucket),
e AS (SELECT coalesce(s.bucket, t.bucket) AS bucket, CAST(coalesce(s, 0) AS DOUBLE) AS s, CAST(coalesce(t, 0) AS DOUBLE) AS t FROM s FULL JOIN t ON s.bucket = t.bucket),
a AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM e),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM e, a),
x AS (SELECT k, count(*) AS n, sum(gain) AS weight FROM o JOIN c USING (word) JOIN g USING (bucket) GROUP BY k),
r AS (
  SELECT doc_id, coalesce(n, 0) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN x USING (k)),
z AS (SELECT doc_id, n, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS FIRST, weight DESC, n DESC) AS place, count(*) FILTER (WHERE n >= 20) OVER () AS whole FROM z)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN n >= 20 AND place <= (10 * whole) // 100 THEN CAST(place AS BIGINT) END AS rank FROM q""",
    "op13_merkle": rf"""
WITH RECURSIVE tab AS (SELECT {_TABLE} AS tab),
x AS (
  SELECT *, coalesce('=' || lang, '') AS grp, row_number() OVER () AS id,
    {_FIELDS.format(n="n_chars")} AS leaf, {_FIELDS.format(n="n_chars + 1")} AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size FROM x),
up AS (
  SELECT grp, 0 AS lvl, pos AS c, size, leaf AS h FROM leaves
  UNION ALL SELECT grp, lvl + 1, c // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY c)) FROM up WHERE size > 1 GROUP BY grp, lvl, c // 2, size),
subs AS (SELECT grp, h AS sub, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS size FROM up WHERE size = 1),
over AS (
  SELECT 0 AS lvl, pos AS c, size, sub AS h FROM subs
  UNION ALL SELECT lvl + 1, c // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY c)) FROM over WHERE size > 1 GROUP BY lvl, c // 2, size),
near AS (
  SELECT l.id, list(struct_pack(h := u.h, left_side := u.c < l.pos >> u.lvl) ORDER BY u.lvl) FILTER (WHERE u.c IS NOT NULL) AS path
  FROM leaves l LEFT JOIN up u ON u.grp = l.grp AND u.c = xor(l.pos >> u.lvl, 1) AND u.size > 1 GROUP BY l.id),
far AS (
  SELECT s.grp, list(struct_pack(h := o.h, left_side := o.c < s.pos >> o.lvl) ORDER BY o.lvl) FILTER (WHERE o.c IS NOT NULL) AS path
  FROM subs s LEFT JOIN over o ON o.c = xor(s.pos >> o.lvl, 1) AND o.size > 1 GROUP BY s.grp),
steps AS (
  SELECT l.id, l.pos, l.size, s.pos AS group_pos, s.size AS groups, sub, coalesce(near.path, []) AS near, coalesce(far.path, []) AS far,
    l.leaf, l.doc_id, CASE WHEN {_CRC.format("coalesce(CAST(l.doc_id AS VARCHAR), '')")} % 7 = 0 AND l.doc_id IS NOT NULL THEN l.changed ELSE l.leaf END AS seen
  FROM leaves l JOIN subs s USING (grp) JOIN near ON near.id = l.id JOIN far ON far.grp = l.grp CROSS JOIN tab),
walk AS (
  SELECT id, seen AS h, pos, size, group_pos, groups, near || far AS path FROM steps
  UNION ALL
  SELECT id, CASE WHEN (CASE WHEN size > 1 THEN size ELSE groups END) % 2 = 1 AND (CASE WHEN size > 1 THEN pos + 1 = size ELSE group_pos + 1 = groups END) THEN sha256(h)
      WHEN path[1].left_side THEN sha256(path[1].h || h) ELSE sha256(h || path[1].h) END,
    CASE WHEN size > 1 THEN pos // 2 ELSE pos END, CASE WHEN size > 1 THEN (size + 1) // 2 ELSE size END,
    CASE WHEN size > 1 THEN group_pos ELSE group_pos // 2 END, CASE WHEN size > 1 THEN groups ELSE (groups + 1) // 2 END,
    CASE WHEN (CASE WHEN size > 1 THEN size ELSE groups END) % 2 = 1 AND (CASE WHEN size > 1 THEN pos + 1 = size ELSE group_pos + 1 = groups END) THEN path ELSE path[2:] END
  FROM walk WHERE size > 1 OR groups > 1)
SELECT s.doc_id, s.leaf, s.sub AS subroot, o.h AS root, sha256(array_to_string(list_transform(s.near || s.far, lambda y: y.h), '')) AS proof_sha256, w.h AS folded_root, w.h = o.h AS verified
FROM steps s JOIN walk w ON w.id = s.id AND w.size = 1 AND w.groups = 1 JOIN over o ON o.size = 1""",
}
