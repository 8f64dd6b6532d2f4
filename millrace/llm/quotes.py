"""Quotation linking: conversations in reply order, without the quotes.

The lines of a message are parsed into passages by the depth of their quote marks. Paragraphs, quoted
or not, are normalised and hashed; a quoted paragraph is joined to the message that has it unquoted:
the latest earlier one of its conversation, or else the first of any other conversation. The message
that a reply quotes most at depth 1 is its parent. Replies follow their parents, oldest first.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from millrace.llm.anchors import lots
from millrace.llm.shared import written

_MARKS = re.compile(r"[ \t]*(?:>[ \t]?)+")
_INTRO = re.compile(r"(?is)^.{0,200}\b(?:wrote|writes|said|écrit|schrieb|escribió)\s*:\s*$")
#: Messages that are put in order at once; a longer conversation is taken whole.
LOT_MESSAGES = 10_000
_NO_WORD = re.compile(r"[\W_]+")


def passages(text: str) -> list[tuple[int, str]]:
    """(depth, text) of the runs of lines with the same depth; depth 0 is the author's own words. A
    line that introduces a quote, such as "A wrote:", belongs to none."""
    out: list[tuple[int, list[str]]] = []
    for line in re.split(r"\r\n|\r|\n", text):
        marks = _MARKS.match(line)
        depth, body = (marks.group().count(">"), line[marks.end() :]) if marks else (0, line)
        if not body.strip() and out:
            depth = depth or (out[-1][0] if not marks and not line else 0)
        if out and out[-1][0] == depth:
            out[-1][1].append(body)
        else:
            out.append((depth, [body]))
    for i, (depth, lines) in enumerate(out[:-1]):
        deeper = out[i + 1][0] > depth
        while deeper and lines and not lines[-1].strip():
            lines.pop()
        if deeper and lines and _INTRO.match(lines[-1]):
            lines.pop()
    return [(d, "\n".join(lines).strip()) for d, lines in out if any(x.strip() for x in lines)]


def paragraph_hashes(text: str) -> list[int]:
    """Hashes of the paragraphs of a passage, which blank lines part, by their words alone."""
    words = (_NO_WORD.sub(" ", p.lower()).strip() for p in re.split(r"\n[ \t]*\n", text))
    return [xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) - (1 << 63) for w in words if w]


_MESSAGE = "id long, conv_id long, turn long, role string, body string, n_quotes int"


def _parse(batches):
    for batch in batches:
        bodies, own, quoted, counts = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = passages(text or "")
            bodies.append("\n\n".join(p for d, p in found if d == 0))
            own.append([h for d, p in found if d == 0 for h in paragraph_hashes(p)])
            marks = [{"depth": d, "hash": h} for d, p in found if d for h in paragraph_hashes(p)]
            quoted.append(marks)
            counts.append(len(marks))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("id", "conv_id", "turn", "role")), pa.array(bodies, pa.string()), pa.array(counts, pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(quoted, pa.list_(pa.struct([("depth", pa.int32()), ("hash", pa.int64())])))],
            ["id", "conv_id", "turn", "role", "body", "n_quotes", "own", "quoted"],
        )


_OUT = ["conv_id", "position", "depth", "turn", "role", "text", "parent_conv_id", "parent_turn", "n_quotes", "n_linked"]


def _ordered(batches):
    """Position and depth of the messages of each conversation; rows come sorted by conversation. Only
    ids are looked at one by one; all else is taken in the order that they give."""
    for table in lots(batches, LOT_MESSAGES, "thread", None):
        conv, ids = table.column("conv_id").to_pylist(), table.column("id").to_pylist()
        parents = [p if c is not None and c == own else None for p, c, own in zip(table.column("parent").to_pylist(), table.column("parent_conv").to_pylist(), conv)]
        order, position, depths, n = [], [], [], len(ids)
        at = 0
        while at < n:
            to = at + 1
            while conv[at] is not None and to < n and conv[to] == conv[at]:
                to += 1
            first, children = {}, {}
            for i in range(at, to):
                first.setdefault(ids[i], i)
            for i in range(at, to):
                p = first.get(parents[i]) if parents[i] is not None else None
                children.setdefault(-1 if p is None or p >= i else p, []).append(i)
            stack = [(i, 0) for i in reversed(children.get(-1, []))]
            while stack:
                i, depth = stack.pop()
                position.append(len(order) - at)
                order.append(i)
                depths.append(depth)
                stack += [(c, depth + 1) for c in reversed(children.get(i, []))]
            at = to
        got = table.take(pa.array(order, pa.int64()))
        columns = {"position": pa.array(position, pa.int32()), "depth": pa.array(depths, pa.int32()), "text": got.column("body"), "parent_conv_id": got.column("parent_conv"), "n_linked": got.column("n_linked").fill_null(0)}
        yield from pa.table([columns[c] if c in columns else got.column(c) for c in _OUT], names=_OUT).combine_chunks().to_batches()


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, position, depth, turn, role, text, parent_conv_id, parent_turn, n_quotes, n_linked):
    each message of (conv_id, turn, role, text) without its quotes, at its place in reply order.

    n_quotes counts quoted paragraphs, n_linked those whose original was found. Of originals with the
    same words the latest earlier one in the conversation counts; of parents quoted equally often, the
    later one. A parent in another conversation is named but doesn't move the reply. Without a parent
    a message stands at depth 0, at its turn. Rows that are alike in all four columns are one message;
    of rows with the same turn the order is by role and text. A null or empty text is a message
    without words; rows with a null conv_id are conversations of one message; a null turn comes first.
    Empty tables: no rows. Other columns are not looked at.
    """
    kept = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    kept = kept.repartition(F.coalesce("conv_id", F.xxhash64("text"))).dropDuplicates()
    parsed = written(kept.withColumn("id", F.xxhash64("conv_id", "turn", "role", "text")).mapInArrow(_parse, f"{_MESSAGE}, own array<long>, quoted array<struct<depth: int, hash: long>>"), "messages")
    place = F.struct("turn", "id")
    own = parsed.select("conv_id", F.explode(F.array_distinct("own")).alias("hash"), place.alias("place"), F.lit(None).cast("int").alias("mark"))
    quotes = parsed.select("conv_id", F.posexplode("quoted").alias("mark", "q"), place.alias("place"))
    asked = quotes.select("conv_id", F.col("q.hash").alias("hash"), "place", "mark").where("conv_id is not null")
    before = W.partitionBy("conv_id", "hash").orderBy("place", F.desc("mark")).rowsBetween(W.unboundedPreceding, -1)
    original = F.last(F.when(F.col("mark").isNull(), F.col("place")), ignorenulls=True).over(before)
    near = own.unionByName(asked).withColumn("original", original).where("mark is not null and original is not null and original.id <> place.id")
    near = near.select("place", "mark", F.struct("conv_id", "original.turn", "original.id").alias("original"))
    firsts = own.groupBy("hash").agg(F.min(F.struct("conv_id", "place.turn", "place.id")).alias("far"), F.max(F.struct("conv_id", "place.turn", "place.id")).alias("last"))
    every = quotes.select("conv_id", "place", "mark", F.col("q.depth").alias("depth"), F.col("q.hash").alias("hash")).join(near, ["place", "mark"], "left")
    open_ = every.where("original is null").drop("original").join(firsts, "hash")
    elsewhere = lambda c: F.col(f"{c}.conv_id").isNotNull() & ~F.col(f"{c}.conv_id").eqNullSafe(F.col("conv_id"))
    open_ = open_.withColumn("original", F.when(elsewhere("far"), F.col("far")).when(elsewhere("last"), F.col("last"))).where("original is not null")
    links = every.where("original is not null").select("place", "depth", "original").unionByName(open_.select("place", "depth", "original"))
    per = links.groupBy("place", "original").agg(F.count("*").alias("n"), F.count_if(F.col("depth") == 1).alias("direct"))
    mine = F.struct("direct", "original.turn", "original.conv_id", "original.id")
    parents = per.groupBy(F.col("place.id").alias("id")).agg(F.sum("n").cast("int").alias("n_linked"), F.max(F.when(F.col("direct") > 0, mine)).alias("best"))
    whole = parsed.drop("own", "quoted").join(parents, "id", "left").select("*", F.col("best.id").alias("parent"), F.col("best.conv_id").alias("parent_conv"), F.col("best.turn").alias("parent_turn")).drop("best")
    order = whole.withColumn("thread", F.coalesce("conv_id", "id")).repartition("thread").sortWithinPartitions("thread", "conv_id", F.asc_nulls_first("turn"), "role", "body", "id")
    return order.mapInArrow(_ordered, "conv_id long, position int, depth int, turn long, role string, text string, parent_conv_id long, parent_turn long, n_quotes int, n_linked int")


def as_mail(conversations: DataFrame) -> DataFrame:
    """Conversations as mail: each message but the first quotes the one it answers, with what that
    one quotes in turn. Every third turn answers the message two turns before, so threads branch."""
    by_turn = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    nth = F.row_number().over(by_turn) - 1
    step = F.when((F.col("nth") % 3 == 0) & (F.col("nth") > 1), 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", "role", "text", nth.alias("nth")).withColumn("step", F.when(F.col("nth") > 0, step))
    for k in (1, 2, 3, 4):
        rows = rows.withColumn(f"t{k}", F.lag("text", k).over(by_turn)).withColumn(f"s{k}", F.lag("step", k).over(by_turn)).withColumn(f"r{k}", F.lag("role", k).over(by_turn))
    pick = lambda c: F.when(F.col("step") == 1, F.col(f"{c}1")).when(F.col("step") == 2, F.col(f"{c}2"))
    far = F.col("step") + pick("s")
    older = F.when(far == 2, F.col("t2")).when(far == 3, F.col("t3")).when(far == 4, F.col("t4"))
    quoted = lambda c, mark: F.regexp_replace(c, r"(?m)^", mark)
    nested = F.when(older.isNotNull(), F.concat(quoted(older, ">> "), F.lit("\n>\n"))).otherwise(F.lit(""))
    mail = F.when(pick("t").isNotNull(), F.concat(pick("r"), F.lit(" wrote:\n"), nested, quoted(pick("t"), "> "), F.lit("\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", mail.alias("text"))
