"""Chat formatting by prefix-target expansion, in DataFrame expressions only.

A turn becomes ``[INST] role[/INST]text</s>``. Inside roles and texts every ``[``, ``<`` and backslash is
followed by a backslash, so no control string can appear there; dropping one backslash after each of the
three restores the text. Every assistant turn becomes an example of its own: all preceding turns are its context, and
only its reply is trainable. An example holds its own last turn and the number of characters of the conversation's
formatted text that come before it; contexts are prefixes of one stored text, so that a long conversation does not
grow with the square of its turns. ``render`` writes whole examples out.

Turns are gathered in two steps (by runs of turn numbers, then by conversation), so that no
task receives a long conversation row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featpipe.llm.common import bound

# fixed values: the control strings of the template
OPEN, HEAD_END, TURN_END = "[INST] ", "[/INST]", "</s>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\[<\\])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\[<\\])\\", "$1")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         run: int = 64) -> DataFrame:
    """One row per conversation: conv_id and its formatted segments, one per turn, in order of turn.

    NULL roles and texts are empty; NULL turns come first; equal turns are ordered by role, then text; repeated
    rows are turns of their own; a NULL conversation id is one conversation. Other columns are not read.
    """
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("t"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("x"))
    runs = rows.groupBy("conv_id", F.floor(F.col("t") / run).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("t", "r", "x"))).alias("part"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "part"))).alias("parts"))
    return whole.select("conv_id", F.transform(
        F.flatten(F.col("parts.part")),
        lambda p: F.concat(F.lit(OPEN), escape(p["r"]), F.lit(HEAD_END), escape(p["x"]), F.lit(TURN_END))).alias("segments"))


def _sum(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda total, n: total + n)


def expand_targets(conversations: DataFrame, target: str = "assistant", run: int = 64) -> DataFrame:
    """One row per turn of the target role: conv_id, example (from 0), context_turns, context_chars, segment
    (the formatted reply turn), loss_start (in the example's text, from 0) and loss_chars (escaped); loss_byte and loss_bytes
    say the same in UTF-8 bytes.

    Sums over the turns before are taken in two steps (inside runs of turns, then over the runs' totals), in the
    conversation's own row. A conversation without turns of the role, or without turns, has no examples; empty replies are
    examples with an empty loss; a NULL conversation id is one conversation; an empty table has none.
    """
    head = OPEN + target + HEAD_END  # the role name holds none of the escaped characters
    n_runs = F.ceil(F.size("segments") / run).cast("int")
    runs = F.when(n_runs > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(n_runs - 1, F.lit(0))), lambda r: F.slice("segments", r * run + 1, F.lit(run))))
    sized = F.transform(runs, lambda p: F.struct(
        p.alias("part"), _sum(F.transform(p, F.length)).alias("chars"), _sum(F.transform(p, F.octet_length)).alias("bytes"),
        F.size(F.filter(p, lambda s: s.startswith(head))).cast("long").alias("targets")))
    rows = bound(conversations.select("conv_id", "segments"), sized=sized).drop("segments")
    zero = F.lit(0).cast("long")
    before = F.aggregate(
        F.slice("sized", 1, F.size("sized") - 1), F.array(F.struct(zero.alias("chars"), zero.alias("bytes"), zero.alias("targets"))),
        lambda done, p: F.concat(done, F.array(F.struct(*[(F.element_at(done, -1)[c] + p[c]).alias(c) for c in ("chars", "bytes", "targets")]))))
    rows = rows.select("conv_id", F.posexplode(F.arrays_zip(F.col("sized.part").alias("part"), before.alias("before"))).alias("r", "z"))
    rows = rows.select("conv_id", "r", F.col("z.part").alias("part"), "z.before.*")

    def turn(s, i):
        ahead = F.slice("part", F.lit(1), i)
        return F.struct(
            s.alias("segment"), (F.col("r") * run + i).alias("context_turns"),
            (F.col("chars") + _sum(F.transform(ahead, F.length))).alias("context_chars"),
            (F.col("bytes") + _sum(F.transform(ahead, F.octet_length))).alias("context_bytes"),
            (F.col("targets") + F.size(F.filter(ahead, lambda x: x.startswith(head)))).alias("example"))

    turns = rows.select("conv_id", F.inline(F.transform("part", turn)))
    return turns.where(F.col("segment").startswith(head)).select(
        "conv_id", "example", "context_turns", "context_chars", "segment",
        (F.col("context_chars") + len(head)).alias("loss_start"),
        (F.length("segment") - len(head) - len(TURN_END)).cast("long").alias("loss_chars"),
        (F.col("context_bytes") + len(head.encode())).alias("loss_byte"),
        (F.octet_length("segment") - len(head.encode()) - len(TURN_END)).cast("long").alias("loss_bytes"))


def render(examples: DataFrame, conversations: DataFrame) -> DataFrame:
    """Examples with their whole text (context and reply turn). Empty tables give an empty table."""
    texts = conversations.select("conv_id", F.array_join("segments", "").alias("conversation"))
    return examples.join(texts, examples["conv_id"].eqNullSafe(texts["conv_id"])).select(
        examples["conv_id"], "example", "loss_start", "loss_chars",
        F.concat(F.expr("substring(conversation, 1, cast(context_chars as int))"), F.col("segment")).alias("text"))


def read_turns(formatted: Column) -> Column:
    """Roles and texts of a formatted conversation, as an array of (role, text)."""
    pieces = F.split(formatted, TURN_END.replace("/", "/"), -1)
    head = lambda s: F.substring_index(s, HEAD_END, 1)
    return F.transform(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda s: F.struct(unescape(F.substr(head(s), F.lit(len(OPEN) + 1))).alias("role"),
                           unescape(F.substr(s, F.length(head(s)) + len(HEAD_END) + 1)).alias("text")))


def masked(examples: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, loss_text (the unescaped text under the loss masks of its examples, in order), n_examples and context_chars (of
    all examples together).

    An example's text is a prefix of its conversation's text, so its loss is read there, at the example's own offset (in
    bytes, which cost the same at every place). Conversations without examples have no row; a NULL id is one conversation.
    """
    masks = examples.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("example", "loss_byte", "loss_bytes"))).alias("masks"),
        F.count("*").alias("n_examples"), F.sum("context_chars").alias("context_chars"))
    texts = conversations.select(F.col("conv_id").alias("c"), "segments")
    both = bound(masks.join(texts, F.col("conv_id").eqNullSafe(F.col("c"))), whole=F.encode(F.array_join("segments", ""), "UTF-8"))
    replies = F.transform("masks", lambda m: unescape(F.decode(
        F.substr("whole", (m["loss_byte"] + 1).cast("int"), m["loss_bytes"].cast("int")), "UTF-8")))
    return both.select("conv_id", F.array_join(replies, "").alias("loss_text"), "n_examples", "context_chars")
