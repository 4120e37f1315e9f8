"""URL filters by rules and link-graph propagation (operator 11).

Rules of hosts and path prefixes decide what they fit. Everything else is judged by its host:
each host seeds trust with the share of its urls that rules allow, and distrust with the share
that they block. Trust flows along the links between hosts (personalised PageRank), distrust
against them, as a host answers for what it links to. A host is blocked where distrust passes a
threshold and outweighs trust.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_empty, join_unique, release, stored

#: Rounds of propagation, and the thousandths of a host's score that it passes on in each.
ROUNDS, PASSED = 20, 850
#: The mass of a whole seed. Scores are whole numbers, so that no order of addition changes them.
UNIT = 1_000_000_000
#: Distrust from which a host is blocked: half of what a host keeps all of whose urls rules block.
LEAST = UNIT * (1000 - PASSED) // 2000
#: Rules are compiled into one expression; more of them belong into a table.
MOST_RULES = 2000

BLANK = r"\x09-\x0D\x20"
#: An <a> whose href names a host, up to the end of the url. "<" ends the search, so time goes with a page's length.
LINK = rf"""<[aA][{BLANK}](?:[^<>]*?[{BLANK}"'])?[hH][rR][eE][fF][{BLANK}]*=[{BLANK}]*["']?[{BLANK}]*(?:[hH][tT][tT][pP][sS]?:)?(//[^{BLANK}"'<>]+)"""


@dataclass(frozen=True)
class Rule:
    """What to do ("allow" or "block") with urls of a host and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, in lower case; empty for null or without "://"."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; of equally long ones, the one with the longer host, then the first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{MOST_RULES} rules at most")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))):
        name = F.when(r.fits(host, path), r.name).otherwise(name)
        verdict = F.when(r.fits(host, path), r.verdict).otherwise(verdict)
    return name, verdict


def judged(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls`` (host, path and others) with rule and verdict, null where no rule fits."""
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return urls.withColumns({"rule": name, "verdict": verdict})


def links_of(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """src, host, path: the source's host and the target of every link that names a host, itself included."""
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1)).alias("to"))
    to = F.concat(F.lit(":"), F.col("to"))
    return found.select("src", host_of(to).alias("host"), path_of(to).alias("path"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, passed: int = PASSED) -> DataFrame:
    """kind, host, score after ``rounds`` of personalised PageRank, for each kind by itself.

    ``edges`` are (kind, src, dst, n) with a weight above 0, ``seeds`` (kind, host, seed) one
    row per node. A round gives each node (1000 - passed)/1000 of its seed, and passed/1000 of
    what its sources hold, shared out by weight; all in whole numbers, rounded down. What a
    node without targets holds is not passed on. Sources with many edges are joined by a
    bounded broadcast, and targets are added up partially before the shuffle.
    """
    own = F.floor(F.col("seed") * (1000 - passed) / 1000).cast("long")
    now = stored(seeds.select("kind", "host", own.alias("score")), "rank-0")
    edges = stored(edges.filter("src <> dst"), "rank-edges")
    if is_empty(edges):
        return now
    nodes = seeds.select("kind", "host", own.alias("own"))
    out = stored(edges.groupBy("kind", "src").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows")), "rank-out")
    m = edges.count()
    for k in range(rounds):
        held = stored(now.withColumnRenamed("host", "src").join(out, ["kind", "src"]).filter("score > 0"), "rank-held")
        given = F.floor(F.col("score").cast("double") * F.col("n") / F.col("total")).cast("long")
        got = join_unique(edges, held, ["kind", "src"], "rows", m).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(given).alias("got"))
        score = F.col("own") + F.floor(F.coalesce("got", F.lit(0)).cast("double") * passed / 1000).cast("long")
        after = stored(nodes.join(got, ["kind", "host"], "left").select("kind", "host", score.alias("score")), f"rank-{k + 1}")
        release(now, held)
        now = after
    release(edges, out)
    return now


def host_scores(seen: DataFrame, links: DataFrame, rounds: int = ROUNDS, passed: int = PASSED) -> DataFrame:
    """host, pages, urls, trust, distrust, blocked of every host, by its ``seen`` urls (host, verdict, own) and ``links`` (src, host)."""
    share = lambda n: F.floor(F.col(n).cast("double") * UNIT / F.col("urls")).cast("long")
    verdict = lambda v: F.count_if(F.col("verdict") == v)
    hosts = stored(seen.groupBy("host").agg(F.count(F.lit(1)).alias("urls"), F.count_if("own").alias("pages"), verdict("allow").alias("allowed"), verdict("block").alias("barred")), "url-hosts")
    both = lambda a, b: F.explode(F.array(F.struct(F.lit("trust").alias("kind"), *a), F.struct(F.lit("distrust").alias("kind"), *b))).alias("x")
    seeds = hosts.select("host", both([share("allowed").alias("seed")], [share("barred").alias("seed")])).select("x.kind", "host", "x.seed")
    pairs = links.groupBy("src", "host").agg(F.count(F.lit(1)).alias("n"))
    ends = lambda a, b: [F.col(a).alias("src"), F.col(b).alias("dst"), F.col("n")]
    edges = pairs.select(both(ends("src", "host"), ends("host", "src"))).select("x.*")
    scores = propagate(edges, seeds, rounds, passed)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0)).alias(kind)
    out = hosts.select("host", "pages", "urls").join(scores.groupBy("host").agg(of("trust"), of("distrust")), "host")
    out = stored(out.withColumn("blocked", (F.col("distrust") >= LEAST) & (F.col("distrust") > F.col("trust"))), "url-scores")
    release(hosts, scores)
    return out


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id",), rounds: int = ROUNDS) -> DataFrame:
    """``keep``, host, path, rule, verdict, by_host of every row: the longest fitting rule's verdict, else that of the host.

    ``by_host`` says which it was. A host's urls are those of the pages and those that links
    name. A null url, or one without "://", has the empty host, which no rule fits and which
    neither sends nor gets links. Null or empty html has no links; repeated rows count each;
    other columns are ignored, and columns of ``keep`` that are named like a result give way
    to it. Without any link or rule every host is allowed. An empty table gives no rows.
    """
    held = [c for c in keep if c not in ("host", "path", "rule", "verdict", "by_host")]
    urls = pages.select(*held, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = stored(judged(urls, rules), "urls")
    links = stored(judged(links_of(pages, url_col, html_col), rules).filter("src <> '' and host <> ''"), "url-links")
    own = lambda df, yes: df.select("host", "verdict", F.lit(yes).alias("own"))
    seen = own(urls, True).unionByName(own(links, False))
    hosts = host_scores(seen, links.select("src", "host"), rounds)
    found = join_unique(urls, hosts.select("host", "pages", "blocked"), ["host"], "pages", urls.count())
    verdict = F.coalesce("verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    release(links)
    return found.select(*held, "host", "path", "rule", verdict.alias("verdict"), F.col("rule").isNull().alias("by_host"))
