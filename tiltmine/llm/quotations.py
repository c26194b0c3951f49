"""Quotation linking in conversations.

Quoted lines (``>``, ``> >``, ``|`` after white space, any depth) are cut from each
message and parsed into passages: runs of lines of one level.  Lines of a table
(``|`` first and once more later) and of a console (``>>> ``, in a run of quoted lines
without other levels and without an introduction) are text, not quotes.  A passage is
normalised (marks off, white space squeezed, lower case) and hashed, as a whole and
line by line; so are the unquoted texts, paragraphs and lines of all messages.  A
passage is linked to the earliest earlier message that says it: in its own
conversation, or else in any other.  Passages of which every line is short
(LEAST_CHARS) are linked by their short parts too, within their conversation and where
no longer part is found; short parts never link conversations.  A message replies to the latest message that
its outermost quotes are linked to; threads are the trees of replies.

Frequent lines do not multiply: of all messages that say a line, only the first of
each conversation, and the first of all in two conversations, are kept for the join
(a reader's own conversation is never the other one).

Defined results: null texts stay null and quote nothing.  A quote of nothing known
is cut and not linked.  An introduction ("... wrote:") directly above a quote goes
with it.  Messages are rows: repeated rows are linked alike.  Rows with a null
conversation form one conversation; rows with a null turn come before all others
and link to nothing.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmine.llm import textkit
from tiltmine.llm.shared import discard, materialize, only

#: Texts, paragraphs and lines shorter than this (normalised) say too little to be linked across conversations.
LEAST_CHARS = 12
#: Doublings of the reply chain that are followed; 2**MOST_STEPS replies deep.
MOST_STEPS = 40
_QUOTE = re.compile(r"^[ \t]*((?:[>|][ \t]?)+)(.*)$")
_INTRODUCTION = re.compile(r"(?:wrote|writes|said|schrieb|écrit|escribió)[^:\n]{0,40}:\s*$", re.I)
_SPACE = re.compile(r"\s+")


def normalised(text: str) -> str:
    return _SPACE.sub(" ", text).strip().lower()


def fingerprint(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _mark(line: str) -> re.Match | None:
    """The quote marks of a line and what follows them; none of a line of a table."""
    m = _QUOTE.match(line)
    return None if m and "|" in m[1] and "|" in m[2] else m


def _consoles(lines: list[str]) -> set[int]:
    """Lines of runs that stand for a console: ``>>> `` without quotes of other levels in the run."""
    out: set[int] = set()
    at = 0
    while at < len(lines):
        to = at
        while to < len(lines) and _mark(lines[to]):
            to += 1
        introduced = at > 0 and bool(_INTRODUCTION.search(lines[at - 1]))
        if to > at and not introduced and all(line.startswith(">>> ") or line.rstrip() == ">>>" for line in lines[at:to]):
            out.update(range(at, to))
        at = max(to, at + 1)
    return out


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and its passages (level, quoted text), in order."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    open_level = 0
    lines = text.split("\n")
    consoles = _consoles(lines) if ">>>" in text else ()
    for at, line in enumerate(lines):
        m = None if at in consoles else _mark(line)
        if not m:
            own.append(line)
            open_level = open_level if not line.strip() else 0
            continue
        level = len(re.sub(r"\s", "", m[1]))
        if _INTRODUCTION.search(m[2]) and level:
            open_level = 0
            continue
        if level != open_level or not passages:
            if not open_level:
                back = len(own) - 1
                while back >= 0 and not own[back].strip():
                    back -= 1
                if back >= 0 and _INTRODUCTION.search(own[back]):
                    del own[back:]
            passages.append((level, []))
            open_level = level
        passages[-1][1].append(m[2])
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n"), [(level, "\n".join(lines)) for level, lines in passages]


def keys(text: str, least: int = LEAST_CHARS) -> set[int]:
    """Hashes of a text, its paragraphs and its lines, normalised, of ``least`` characters or more."""
    parts = [text, *re.split(r"\n\s*\n", text), *text.split("\n")]
    return {fingerprint(n) for n in map(normalised, parts) if len(n) >= least}


def short_keys(passage: str) -> set[int]:
    """Hashes of the short parts of a passage that has no other lines."""
    if any(len(normalised(line)) >= LEAST_CHARS for line in passage.split("\n")):
        return set()
    return keys(passage, 1) - keys(passage)


_PARSED = "row long, conv_id long, turn long, role string, text string, said array<long>, quoted array<struct<level:int,long:array<long>,short:array<long>>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quote = pa.list_(pa.struct([("level", pa.int32()), ("long", pa.list_(pa.int64())), ("short", pa.list_(pa.int64()))]))
    for batch in textkit.chunks(batches):
        texts, said, quoted = [], [], []
        for t in batch.column("text").to_pylist():
            own, passages = (None, []) if t is None else parse(t)
            texts.append(own)
            said.append(sorted(keys(own or "", 1)))
            quoted.append([{"level": level, "long": sorted(keys(q)), "short": sorted(short_keys(q))} for level, q in passages])
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("row", "conv_id", "turn", "role")] + [pa.array(texts, pa.string()), pa.array(said, pa.list_(pa.int64())), pa.array(quoted, quote)],
            names=["row", "conv_id", "turn", "role", "text", "said", "quoted"],
        )


def link(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages without quotes, and links (row, passage, level, to_conv, to_turn) of their passages."""
    numbered = only(messages, "conv_id", "turn", "role", "text").select(
        F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text"
    )
    parsed = materialize(numbered.mapInArrow(_parse, _PARSED), "messages")
    place = F.struct("turn", "conv_id")
    said = parsed.where("turn is not null").select("conv_id", "turn", F.explode("said").alias("hash"))
    here = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("here"))
    passages = parsed.where("turn is not null").select("row", "conv_id", "turn", F.posexplode("quoted").alias("passage", "q"))
    marked = lambda column, wide: F.transform(column, lambda h: F.struct(h.alias("hash"), F.lit(wide).alias("wide")))
    asked = passages.select("row", "conv_id", "turn", "passage", "q.level", F.explode(F.concat(marked("q.long", True), marked("q.short", False))).alias("k"))
    asked = asked.select("row", "conv_id", "turn", "passage", "level", "k.hash", "k.wide")
    asked = materialize(asked, "asked")
    # only what is asked for is looked up elsewhere, and nothing short
    wanted = asked.where("wide").select("hash").distinct()
    elsewhere = materialize(here.join(wanted, "hash", "left_semi").select("hash", F.struct(F.col("here").alias("turn"), "conv_id").alias("said")), "elsewhere")
    # the first of all, and the first in another conversation than that one, for readers who are in it
    there = materialize(elsewhere.groupBy("hash").agg(F.min("said").alias("there")), "there")
    second = elsewhere.join(there, "hash").where(~F.col("said.conv_id").eqNullSafe(F.col("there.conv_id"))).groupBy("hash").agg(F.min("said").alias("second"))
    there = there.join(second, "hash", "left")
    found = asked.alias("a").join(here.alias("h"), F.col("a.conv_id").eqNullSafe(F.col("h.conv_id")) & (F.col("a.hash") == F.col("h.hash")) & (F.col("h.here") < F.col("a.turn")), "left")
    found = found.select("a.*", F.when(F.col("here").isNotNull(), F.struct(F.col("here").alias("turn"), F.col("a.conv_id").alias("conv_id"))).alias("near"))
    wide = found.where("wide").join(there, "hash", "left").withColumn("far", F.when(~F.col("there.conv_id").eqNullSafe(F.col("conv_id")), F.col("there")).otherwise(F.col("second")))
    wide = wide.select("row", "passage", "level", "near", "far", F.lit(None).cast("struct<turn:long,conv_id:long>").alias("brief"))
    short = found.where("not wide").select("row", "passage", "level", F.lit(None).cast("struct<turn:long,conv_id:long>").alias("near"), F.lit(None).cast("struct<turn:long,conv_id:long>").alias("far"), F.col("near").alias("brief"))
    best = wide.unionByName(short).groupBy("row", "passage", "level").agg(F.max("near").alias("near"), F.min("far").alias("far"), F.max("brief").alias("brief"))
    best = best.withColumn("near", F.coalesce("near", F.when(F.col("far").isNull(), F.col("brief"))))
    links = best.withColumn("to", F.coalesce("near", "far")).where("to is not null").select("row", "passage", "level", F.col("to.conv_id").alias("to_conv"), F.col("to.turn").alias("to_turn"), F.col("near").isNotNull().alias("inside"))
    return parsed, links


def rebuild(messages: DataFrame) -> DataFrame:
    """Reply-ordered conversations without quotes: a row a message.

    (conv_id, turn, role, text, quotes, linked, reply_to, reply_conv, thread, depth): ``reply_to`` is the turn that
    is answered, ``thread`` the turn that its chain of replies in the conversation starts from, ``depth`` its length.  Sorted by
    (conv_id, thread, depth, turn), a message comes after the one that it answers.
    """
    parsed, links = link(messages)
    outer = links.groupBy("row").agg(F.min("level").alias("outer"), F.count(F.lit(1)).alias("linked"))
    parent = links.join(outer, "row").where("level = outer").groupBy("row").agg(F.max("linked").alias("linked"), F.max(F.struct("inside", "to_turn", "to_conv")).alias("p"))
    out = parsed.join(parent, "row", "left").select(
        "row", "conv_id", "turn", "role", "text", F.size("quoted").alias("quotes"), F.coalesce("linked", F.lit(0)).cast("int").alias("linked"), F.col("p.to_turn").alias("reply_to"), F.col("p.to_conv").alias("reply_conv"), F.coalesce("p.inside", F.lit(False)).alias("inside")
    )
    # chains inside a conversation are followed by doubling: every row jumps to where its parent has jumped
    now = materialize(out.select("row", "conv_id", "turn", F.when(F.col("inside"), F.col("reply_to")).otherwise(F.col("turn")).alias("up"), F.col("inside").cast("long").alias("depth")), "chains")
    for _ in range(MOST_STEPS):
        tops = now.groupBy("conv_id", "turn").agg(F.min(F.struct("up", "depth")).alias("t"))
        after = now.alias("n").join(tops.alias("t"), F.col("n.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("n.up") == F.col("t.turn")) & (F.col("n.up") != F.col("n.turn")), "left")
        after = after.select("n.row", "n.conv_id", "n.turn", F.coalesce("t.t.up", "n.up").alias("up"), (F.col("n.depth") + F.coalesce("t.t.depth", F.lit(0))).alias("depth"))
        after = materialize(after, "chains")
        same = now.agg(F.sum("depth")).first()[0] == after.agg(F.sum("depth")).first()[0]  # a jump only adds to a depth
        discard(now)
        now = after
        if same:
            break
    chains = now.select("row", F.col("up").alias("thread"), F.col("depth").cast("int").alias("depth"))
    return out.join(chains, "row").select("conv_id", "turn", "role", "text", "quotes", "linked", "reply_to", "reply_conv", "thread", "depth")
