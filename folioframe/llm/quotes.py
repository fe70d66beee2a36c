"""Chat formatting by quotation linking.

Each message is parsed into its own passages and the passages it quotes, by
nested levels of ``>``. Passages and their lines are normalised and hashed;
quoted hashes are joined, within the conversation, to the message that said
them first. The parent of a message is the original of its shallowest linked
quote. Threads are resolved by pointer doubling, and the messages are
returned in reply order with the quotes taken out.

The originals are reduced to one turn for each (conversation, hash) before
the join, so a passage that a third of all messages repeats meets one row; and
where many messages quote one passage, or answer in one thread, its row is
broadcast (``join_unique``), so that no hot passage, thread or repeated message
meets in one task. The last sort tells equal rows apart by a row number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_unique, materialise, pick, table

QUOTED = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.DOTALL)
WHOLE = 1_000_000


def normalised(text: str) -> str:
    return " ".join(text.casefold().split())


def digest(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def passages(text: str | None) -> list[tuple[int, list[str]]]:
    """Runs of lines of one quote level, as (level, lines without their marks); level 0 is the author's own."""
    found: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        mark = QUOTED.fullmatch(line)
        level, body = (mark[1].count(">"), mark[2]) if mark else (0, line)
        if found and found[-1][0] == level:
            found[-1][1].append(body)
        else:
            found.append((level, [body]))
    return found


def introduces(line: str) -> bool:
    """Whether a line, of any length, announces a quote: "On ... wrote:" and its like in four languages."""
    body = line.strip()
    words = body[:-1].split() if body.endswith(":") else []
    if len(words) < 3 or words[0] not in ("On", "Am", "Le", "El"):
        return False
    return words[-1] in ("wrote", "escribió") or (len(words) > 3 and words[-2:] == ["a", "écrit"]) or any(w.startswith("schrieb") for w in words[2:])


def unquoted(found: list[tuple[int, list[str]]]) -> str:
    """The author's own lines; a line that introduces a quote ("On ... wrote:") goes with it."""
    own: list[str] = []
    for i, (level, lines) in enumerate(found):
        if level:
            continue
        kept = list(lines)
        if i + 1 < len(found):
            while kept and not kept[-1].strip():
                kept.pop()
            if kept and introduces(kept[-1]):
                kept.pop()
        own += kept
    return "\n".join(own).strip("\n") if len(found) > 1 or (found and found[0][0]) else "\n".join(own)


def hashes(lines: list[str]) -> list[tuple[int, int]]:
    """(hash, weight) of the passage as a whole and of each of its lines that says something."""
    whole = normalised(" ".join(lines))
    if not whole:
        return []
    each = {digest(n) for n in map(normalised, lines) if n}
    return [(digest(whole), WHOLE), *((h, 1) for h in sorted(each - {digest(whole)}))]


def parsed_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own text, hashes of what the author says, and the quotes as (level, [(hash, weight)])."""
    frame = pick(messages, "conv_id", "turn", "role", "text")
    kind = lambda c: frame.schema[c].dataType.simpleString()
    schema = f"conv_id {kind('conv_id')}, turn {kind('turn')}, role {kind('role')}, own string, said array<bigint>, quotes array<struct<level:int,parts:array<struct<h:bigint,weight:bigint>>>>"
    part = pa.list_(pa.struct([("h", pa.int64()), ("weight", pa.int64())]))
    quote = pa.list_(pa.struct([("level", pa.int32()), ("parts", part)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, said, quotes = [], [], []
            for text in batch.column(3):
                found = passages(text.as_py())
                mine = unquoted(found)
                own.append(None if text.as_py() is None else mine)
                spoken = {h for level, lines in found if not level for h, _ in hashes(lines)}
                for block in re.split(r"\n\s*\n", mine):
                    spoken |= {h for h, _ in hashes(block.split("\n"))}
                spoken |= {h for h, _ in hashes(mine.split("\n"))}
                said.append(sorted(spoken))
                quotes.append([{"level": level, "parts": [{"h": h, "weight": w} for h, w in parts]} for level, lines in found if level and (parts := hashes(lines))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(own, pa.string()), pa.array(said, pa.list_(pa.int64())), pa.array(quotes, quote)], names=["conv_id", "turn", "role", "own", "said", "quotes"]
            )

    return frame.mapInArrow(run, schema)


def _conversation() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c")


def threads(parents: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(c, turn, root, depth) of every message that has a parent, from (c, turn, parent) with parent < turn, unique by c and turn."""
    state = materialise(parents.select("c", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        above = state.select("c", F.col("turn").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        joined = join_unique(state, above, ["c", "root"], "left", rows)
        state = materialise(joined.select("c", "turn", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "threads")
        if state.filter("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def link_quotations(messages: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every message without its quotes, in reply order: by conversation, thread root, depth and turn.

    Columns: conv_id, turn, role, text (the author's own words), n_quotes
    (quoted passages), n_linked (those whose original was found), levels (the
    deepest quote), parent_turn, root_turn, reply_depth. A message with no
    linked quote is the root of its own thread. Of originals that tie the
    earliest wins, of quotes of one level the first. Messages without a turn
    are neither originals nor replies; null texts stay null and say nothing,
    empty ones say nothing; null conversations form one; repeated rows are
    each returned; a message of any length is read whole; columns that aren't
    named here are not looked at whatever their names; an empty table gives no
    rows. Joins broadcast up to ``rows`` rows, beyond it only hot keys.
    """
    parsed = materialise(parsed_messages(messages).withColumn("c", _conversation()).withColumn("m", F.xxhash64("c", "turn", "quotes")), "messages")
    first = materialise(parsed.filter("turn is not null").select("c", "turn", F.explode("said").alias("h")).groupBy("c", "h").agg(F.min("turn").alias("origin")), "said-first")
    quoting = parsed.filter("turn is not null and size(quotes) > 0").select("c", "turn", "m", "quotes").distinct()
    wanted = quoting.select("c", "turn", "m", F.posexplode("quotes").alias("no", "q")).select("c", "turn", "m", "no", F.col("q.level").alias("level"), F.explode("q.parts").alias("part")).select("c", "turn", "m", "no", "level", "part.h", "part.weight")
    met = join_unique(materialise(wanted, "quoted"), first, ["c", "h"], "inner", rows).filter("origin < turn")
    votes = met.groupBy("c", "turn", "m", "no", "level", "origin").agg(F.sum("weight").alias("weight"))
    linked = votes.groupBy("c", "turn", "m", "no", "level").agg(F.max_by("origin", F.struct("weight", -F.col("origin"))).alias("origin"))
    chosen = materialise(linked.groupBy("c", "turn", "m").agg(F.min_by("origin", F.struct("level", "no")).alias("parent"), F.count(F.lit(1)).alias("n_linked")), "parents")
    rooted = threads(chosen.groupBy("c", "turn").agg(F.min("parent").alias("parent")), rows)
    replies = join_unique(chosen, rooted, ["c", "turn"], "left", rows).select("m", F.col("parent").alias("parent_turn"), "n_linked", F.col("root").alias("root_turn"), F.col("depth").alias("reply_depth"))
    whole = join_unique(parsed, materialise(replies, "replies"), ["m"], "left", rows).select(
        "conv_id",
        "turn",
        "role",
        F.col("own").alias("text"),
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce(F.array_max(F.col("quotes.level")), F.lit(0)).cast("long").alias("levels"),
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("reply_depth", F.lit(0)).cast("long").alias("reply_depth"),
        F.monotonically_increasing_id().alias("place"),
    )
    return whole.orderBy("conv_id", "root_turn", "reply_depth", "turn", "place").drop("place")


def op6_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))
