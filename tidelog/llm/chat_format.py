"""Chat formatting of reply trees (operator 1).

Messages point to their parent. Rounds of self-joins double the length of every message's
pointer towards the root, so a chain of n messages takes log2(n) joins, and add up scores on
the way. Every leaf then has the score of its root-to-leaf path; the best branches of each
tree are chosen, expanded with the same doubling pointers and formatted as one conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, is_empty, small_batches, stored

#: ``### role: text </turn>\n`` a turn; a backslash goes before these strings inside a role or text.
TURN, END = "### ", " </turn>\n"
_ESCAPE = re.compile(r"\\|###|</turn>|:(?= )")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
#: An escaped string or the end of a role, and of a text.
_ROLE_END, _TEXT_END = (re.compile(rf"\\(?:\\|###|</turn>|:)|({end})") for end in (": ", "</turn>"))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def format_turns(turns: list[tuple[str, str]], learn: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the spans of code points that training learns from."""
    out: list[str] = []
    mask: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}: ", escape(text)
        if role in learn:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += head, body, END
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def _until(end: re.Pattern, formatted: str, at: int) -> tuple[int, int]:
    """Where the first ``end`` that isn't escaped begins and ends."""
    m = next((m for m in end.finditer(formatted, at) if m[1]), None)
    if m is None:
        raise ValueError(f"a turn doesn't end after {at}")
    return m.span()


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the inverse of ``format_turns``."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        role, text = _until(_ROLE_END, formatted, at + len(TURN))
        last, end = _until(_TEXT_END, formatted, text)
        if formatted[last - 1 : end + 1] != END or last <= text:
            raise ValueError(f"no end of a turn at {last}")
        out.append((unescape(formatted[at + len(TURN) : role]), unescape(formatted[text : last - 1])))
        at = end + 1
    return out


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """tree, leaf, msg, pos, score: the messages of each tree's ``top`` best root-to-leaf paths.

    ``messages``: tree, msg, parent, score. A path's score is the mean of its messages'
    scores (null counts as 0); ties go to the smaller leaf. A message whose parent isn't in
    its tree is a root. Messages on a cycle, or below one, have no root and are left out.
    """
    nodes = messages.select("tree", "msg", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    ids = nodes.select("tree", F.col("msg").alias("parent"), F.lit(True).alias("known"))
    up = nodes.join(ids, ["tree", "parent"], "left").select("tree", "msg", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("depth"))
    levels = [stored(up, "chat-level")]
    most = levels[0].count()
    while not is_empty(levels[-1].filter("up is not null")) and 1 << (len(levels) - 1) <= most:
        a = levels[-1]
        b = a.select("tree", F.col("msg").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("depth").alias("depth2"))
        done = a.filter("up is null")  # at its root: only messages further down take part in a round
        a = a.filter("up is not null").join(b, ["tree", "up"], "left").select("tree", "msg", F.col("up2").alias("up"), (F.col("sum") + F.coalesce("sum2", F.lit(0.0))).alias("sum"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))
        a = a.unionByName(done)
        levels.append(stored(a, "chat-level"))
    parents = levels[0].filter("up is not null").select("tree", F.col("up").alias("msg"))
    leaves = levels[-1].filter("up is null").join(parents, ["tree", "msg"], "left_anti")
    scored = leaves.select("tree", F.col("msg").alias("leaf"), (F.col("sum") / F.col("depth")).alias("score"), "depth")
    if top == 1:  # a partial aggregate: a tree of any width ranks without meeting in one task
        best = F.max_by(F.struct("leaf", "score", "depth"), F.struct("score", (-F.col("leaf")).alias("first")))
        chosen = scored.groupBy("tree").agg(best.alias("s")).select("tree", "s.*")
    else:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
        chosen = scored.withColumn("rank", rank).filter(F.col("rank") <= top).drop("rank")
    paths = stored(chosen.select("tree", "leaf", F.col("leaf").alias("msg"), F.lit(0).cast("long").alias("back"), "score", "depth"), "chat-paths")
    for k, level in enumerate(levels[:-1]):
        step = level.filter("up is not null").select("tree", "msg", "up")
        far = paths.join(step, ["tree", "msg"]).select("tree", "leaf", F.col("up").alias("msg"), (F.col("back") + (1 << k)).alias("back"), "score", "depth")
        paths = stored(paths.unionAll(far), "chat-paths")
    return paths.select("tree", "leaf", "msg", (F.col("depth") - 1 - F.col("back")).alias("pos"), "score")


def _format(learn: frozenset[str]):
    schema = pa.schema([("tree", pa.string()), ("leaf", pa.int64()), ("score", pa.float64()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                formatted, mask = format_turns([(t["role"], t["text"]) for t in r["turns"]], learn)
                rows.append({"tree": r["tree"], "leaf": r["leaf"], "score": r["score"], "formatted": formatted, "mask": [{"start": a, "end": b} for a, b in mask]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def format_chats(messages: DataFrame, top: int = 1, learn: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """tree, leaf, score, formatted, mask: one conversation for each chosen path.

    ``messages``: tree string, msg long, parent long, score double, role, text. A null role
    or text is empty. Messages without a tree form one of their own. Of a message that is
    repeated in its tree the one with the smallest parent, score, role and text counts (nulls
    first); one without a msg can't be placed and is left out. Other columns are ignored; an
    empty table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit(""))  # a join on a null would lose its rows
    messages = messages.select(tree.alias("tree"), F.col("msg").cast("long").alias("msg"), F.col("parent").cast("long").alias("parent"), F.col("score").cast("double").alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    messages = messages.filter("msg is not null")
    small_batches(messages.sparkSession)
    if not is_empty(messages.groupBy("tree", "msg").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")):
        messages = messages.groupBy("tree", "msg").agg(F.min(F.struct("parent", "score", "role", "text")).alias("m")).select("tree", "msg", "m.*")
    with Scratch() as s:
        best = s.keep(stored(best_paths(messages, top), "chat-best"))
    path = best.join(messages.select("tree", "msg", "role", "text"), ["tree", "msg"])
    turns = path.groupBy("tree", "leaf", "score").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    turns = turns.withColumn("tree", F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)))
    return turns.mapInArrow(_format(learn), "tree string, leaf long, score double, formatted string, mask array<struct<start:long,end:long>>")


def thread_of(conversations: DataFrame) -> DataFrame:
    """Flat conversations (conv_id, turn, role, text) as reply trees that are single chains.

    Rows go by turn, then by role and text where turns repeat; null turns come first. Rows
    without a conv_id form one conversation of their own, without a tree. Each row answers the one before it.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("msg", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").cast("string").alias("tree"), "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
