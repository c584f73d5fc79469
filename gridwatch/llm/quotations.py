"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks (spaces between them allowed) are quotes of that level; the others are a
message's own text. Consecutive lines of one level are a passage; a passage is normalised (lower case, white
space as one space, quotes of deeper levels left out) and hashed. An original message offers the hash of its
whole own text and of each of its own lines and paragraphs; a quoted passage links to the first message of its
conversation that offers its hash, if that came earlier. A passage that nobody offers as a whole is a trimmed
quote: its parts (lines, sentences, and runs of ``RUN`` words within them) are looked up among the parts of the
earlier messages, and it links to the one that offers most of its different parts, the first one among equals,
if that is more than half of its lines and sentences or of its runs. A message replies to the latest message
that its outermost linked passages quote; without any it stands in the main line.

Replies come right after what they reply to: ``path`` holds the turns from a message's outermost ancestor
to itself, and arrays in that order read a conversation with each reply under its message. Paths are built by
doubling, so their rounds grow with the logarithm of the depth; no conversation is gathered in one task.
``formatted`` is the message in a role template without quotes and without the lines that announce them;
``conversations`` joins them in that order. The paths of a chain of replies take the square of its length.

Null texts count as empty; a message with no own text keeps its row. Null conv_id or turn: the row links with
nothing and its path is its turn. Rows that repeat a conversation and turn are kept; links go to the turn.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

_MARKS = re.compile(r"^\s{0,3}((?:>\s?)+)(.*)$")
_ANNOUNCES = re.compile(r"^.{0,200}\b(?:wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Words of a run, by which parts of a line or of wrapped lines are found.
RUN = 5
SCHEMA = "conv_id bigint, turn bigint, role string, own string, offers array<bigint>, quotes array<struct<level:int,hash:bigint,lines:array<bigint>,runs:array<bigint>>>"
_QUOTES = pa.list_(pa.struct({"level": pa.int32(), "hash": pa.int64(), "lines": pa.list_(pa.int64()), "runs": pa.list_(pa.int64())}))


def _hash(lines: list[str]) -> int | None:
    text = _SPACE.sub(" ", " ".join(lines)).strip().lower()
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) if text else None


def parts(lines: list[str]) -> tuple[list[int], list[int]]:
    """Hashes of the lines and their sentences, and of the runs of ``RUN`` words."""
    whole = {_hash([x]) for t in lines for x in (t, *_SENTENCE.split(t))} - {None}
    words = " ".join(lines).split()
    return sorted(whole), sorted({_hash(words[i : i + RUN]) for i in range(len(words) - RUN + 1)})


def parse(text: str | None) -> tuple[str, list[int], list[tuple[int, int, list[int], list[int]]]]:
    """A message's own text, the hashes it offers, and level, hash and parts of the passages it quotes."""
    levels = []
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        levels.append((m[1].count(">"), m[2]) if m else (0, line))
    own = [t for i, (v, t) in enumerate(levels) if v == 0 and not (i + 1 < len(levels) and levels[i + 1][0] > 0 and _ANNOUNCES.match(t))]
    paragraphs, part = [], []
    for t in [*own, ""]:
        if t.strip():
            part.append(t)
        else:
            paragraphs.append(part)
            part = []
    offers = {_hash(x) for x in (own, *paragraphs, *([t] for t in own))} - {None}
    quotes = []
    for level in range(1, max((v for v, _ in levels), default=0) + 1):
        run: list[str] = []
        for v, t in [*levels, (0, "")]:
            if v == level:
                run.append(t)
            elif v < level and run:  # deeper quotes inside a passage aren't its own words
                quotes += [(level, h, *parts(run)) for h in [_hash(run)] if h is not None]
                run = []
    return "\n".join(own).strip(), sorted(offers), quotes


def _trimmed(parsed: DataFrame, loose: DataFrame) -> DataFrame:
    """The passages of ``loose`` that an earlier message offers in parts, with that message as ``source``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, runs = zip(*(parts(t.split("\n")) for t in b.column(2).to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lines, pa.list_(pa.int64())), pa.array(runs, pa.list_(pa.int64()))], names=["conv_id", "source", "lines", "runs"])

    def each(df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*keys, F.lit(0).alias("kind"), F.explode("lines").alias("part")).unionByName(df.select(*keys, F.lit(1).alias("kind"), F.explode("runs").alias("part")))

    quotes = parsed.where("size(quotes) > 0").select("conv_id", F.explode("quotes").alias("q")).select("conv_id", "q.hash", "q.lines", "q.runs")
    passages = quotes.join(loose, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min(F.struct("lines", "runs")).alias("p"))
    passages = stored(passages.select("conv_id", "hash", "p.lines", "p.runs"), "passages")
    asked = each(passages, "conv_id", "hash")
    # of equal messages the first one counts
    firsts = parsed.where("own != ''").groupBy("conv_id", "own").agg(F.min("turn").alias("turn")).select("conv_id", "turn", "own")
    offered = each(firsts.mapInArrow(run, "conv_id bigint, source bigint, lines array<bigint>, runs array<bigint>"), "conv_id", "source")
    met = asked.join(offered, ["conv_id", "kind", "part"]).select("conv_id", "hash", "source", "kind", "part").distinct()
    met = met.groupBy("conv_id", "hash", "source").agg(F.count("*").alias("n"), F.sum("kind").alias("n_runs"))
    enough = (2 * (F.col("n") - F.col("n_runs")) > F.size("lines")) | (2 * F.col("n_runs") > F.size("runs"))
    good = met.join(passages, ["conv_id", "hash"]).where(enough).select("conv_id", "hash", "source", "n")
    best = loose.join(good, ["conv_id", "hash"]).where("source < turn").groupBy("conv_id", "turn", "level", "hash").agg(F.max(F.struct("n", (-F.col("source")).alias("s"))).alias("m"))
    return best.select("conv_id", "turn", "level", "hash", (-F.col("m.s")).alias("source"))


def reply_ordered(messages: DataFrame, template: str = "<|{role}|>\n{text}\n", max_rounds: int = 40) -> DataFrame:
    """``conv_id, turn, role, n_quotes, n_linked, reply_to, depth, path, formatted`` of every message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, offers, quotes = zip(*map(parse, b.column(3).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(own, pa.string()), pa.array(offers, pa.list_(pa.int64())), pa.array([[dict(zip(("level", "hash", "lines", "runs"), x, strict=True)) for x in q] for q in quotes], _QUOTES)],
                names=["conv_id", "turn", "role", "own", "offers", "quotes"],
            )

    given = messages.select(*(messages[c].cast(t).alias(c) for c, t in (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))))
    parsed = stored(given.mapInArrow(run, SCHEMA), "messages")
    quoted = parsed.where("size(quotes) > 0").select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.hash").distinct()
    quoted = stored(quoted, "quoted")
    asked = quoted.select("conv_id", "hash").distinct()
    offered = parsed.select("conv_id", F.explode("offers").alias("hash"), "turn").join(asked, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    linked = stored(quoted.join(stored(offered, "offered"), ["conv_id", "hash"]).where("source < turn"), "linked")
    loose = stored(quoted.join(linked, ["conv_id", "turn", "level", "hash"], "left_anti").where("conv_id is not null"), "loose")
    if loose.limit(1).count():
        linked = linked.unionByName(_trimmed(parsed, loose))
    outermost = linked.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("v"), "source")).alias("m"), F.count("*").alias("n_linked"))
    replies = stored(outermost.select("conv_id", "turn", F.col("m.source").alias("reply_to"), "n_linked"), "replies")

    # path: from the message that the doubling has reached down to the message; top: the one before it, if any
    paths = stored(replies.select("conv_id", "turn", F.array("turn").alias("path"), F.col("reply_to").alias("top")), "paths")
    for _ in range(max_rounds):
        up = paths.select("conv_id", F.col("turn").alias("top"), F.col("path").alias("more"), F.col("top").alias("next"))
        open_ = paths.where("top is not null")
        if not open_.limit(1).count():
            break
        grown = open_.join(up, ["conv_id", "top"], "left").select(
            "conv_id", "turn", F.when(F.col("more").isNull(), F.concat(F.array("top"), "path")).otherwise(F.concat("more", "path")).alias("path"), "next"
        )
        paths = stored(paths.where("top is null").unionByName(grown.withColumnRenamed("next", "top")), "paths")
    else:
        raise RuntimeError("a chain of replies is longer than the rounds reach")
    out = parsed.select("conv_id", "turn", "role", F.size("quotes").alias("n_quotes"), "own")
    out = out.join(replies, ["conv_id", "turn"], "left").join(paths.select("conv_id", "turn", "path"), ["conv_id", "turn"], "left")
    before, between, after = template.partition("{role}")[0], template.partition("{role}")[2].partition("{text}")[0], template.partition("{text}")[2]
    text = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit(between), "own", F.lit(after))
    path = F.coalesce("path", F.array("turn"))
    return out.select("conv_id", "turn", "role", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "reply_to", (F.size(path) - 1).alias("depth"), path.alias("path"), text.alias("formatted"))


def conversations(messages: DataFrame, template: str = "<|{role}|>\n{text}\n", turns_a_part: int = 1000) -> DataFrame:
    """``conv_id, part, n_messages, n_linked, turns, text``: each conversation in reply order without quotes.

    Messages of ``turns_a_part`` turns of the main line, with all replies to them, make a part, so that a long conversation is
    several rows, in order of ``part``. A message without conv_id is a conversation of its own."""
    rows = reply_ordered(messages, template)
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    part = F.coalesce(F.floor(F.get("path", F.lit(0)) / turns_a_part), F.lit(0)).cast("bigint")
    in_order = F.array_sort(F.collect_list(F.struct("path", "turn", "formatted", "n_linked")))
    one = rows.groupBy("conv_id", part.alias("part"), alone.alias("alone")).agg(in_order.alias("m"))
    return one.select(
        "conv_id", "part", F.size("m").alias("n_messages"), F.aggregate("m", F.lit(0).cast("bigint"), lambda n, x: n + x["n_linked"]).alias("n_linked"),
        F.transform("m", lambda x: x["turn"]).alias("turns"), F.array_join(F.transform("m", lambda x: x["formatted"]), "").alias("text"),
    )
