"""Conversations as text for training, with a mask of what the loss counts.

Template: each run of turns of one role is one message,

    <|im_start|>role<|im_sep|>text<|im_turn|>text ... <|im_end|>

so neighbouring turns of one role share a message and stay apart in it. Inside roles and texts a
backslash becomes two, and `<|` becomes `<\\|`; so control strings never occur inside them, and
unescaping is one pass. The loss counts the texts of assistant turns, escaped as they stand.

Turns are collected in blocks of turn numbers, sorted, merged by array aggregation over slices of
bounded length, and the blocks' pieces are put together in order. So no sort and no merge ever
takes a whole long conversation; only the finished string does. DataFrame expressions only.

Defined results: null texts and roles count as empty; rows are ordered by turn (null first), then
role, then text, so repeated rows stay, one beside the other; rows with a null conv_id form one
conversation; empty texts are turns like others; other columns aren't looked at; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>"
LEARNED = "assistant"
#: Turn numbers in a block, and turns merged in one aggregation.
BLOCK = 512
SLICE = 128


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _merged(turns: Column) -> Column:
    """Runs of one role (role, texts) from sorted turns, by aggregation."""
    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def step(runs: Column, t: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        alone = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        return F.when((F.size(runs) > 0) & (last["role"] == t["role"]), F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(alone)))

    return F.aggregate(turns, empty, step)


def _pieces(runs: Column) -> Column:
    """Pieces (text, loss) of a slice's messages, without the first message's head and the last one's end."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def message(run: Column, i: Column) -> Column:
        learned = run["role"] == LEARNED
        texts = F.transform(run["texts"], lambda t, k: F.array(piece(F.when(k > 0, F.lit(TURN)).when(i > 0, F.concat(F.lit(END + START), escape(run["role"]), F.lit(SEP))).otherwise(F.lit("")), no), piece(escape(t), learned)))
        return F.flatten(texts)

    return F.flatten(F.transform(runs, message))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, pieces: the string, and its cuts (text, loss) in order, of which the string consists."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    block = F.floor(F.col("turn") / BLOCK)
    collected = rows.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / SLICE).cast("int")), lambda k: _merged(F.slice("turns", k * SLICE + 1, F.lit(SLICE))))
    ready = collected.select("conv_id", "block", F.transform(slices, lambda runs: F.struct(runs[0]["role"].alias("first"), F.element_at(runs, -1)["role"].alias("last"), _pieces(runs).alias("pieces"))).alias("slices"))
    whole = ready.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "slices"))), lambda b: b["slices"])).alias("slices"))
    piece = lambda text: F.array(F.struct(text.alias("text"), F.lit(False).alias("loss")))

    def joined(s: Column, i: Column) -> Column:
        head = F.concat(F.lit(START), escape(s["first"]), F.lit(SEP))
        before = F.try_element_at(F.col("slices"), F.when(i > 0, i).otherwise(1))
        return F.concat(piece(F.when(i == 0, head).when(before["last"] == s["first"], F.lit(TURN)).otherwise(F.concat(F.lit(END), head))), s["pieces"])

    pieces = F.filter(F.concat(F.flatten(F.transform("slices", joined)), piece(F.lit(END))), lambda p: p["loss"] | (p["text"] != ""))
    return whole.select("conv_id", pieces.alias("pieces")).select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def parsed(text: Column) -> Column:
    """The turns (role, text) that a formatted string holds."""
    messages = F.filter(F.transform(F.split(text, r"<\|im_end\|>"), lambda m: F.split(m, r"<\|im_sep\|>")), lambda m: F.size(m) == 2)
    # a lambda evaluates its expressions for each element, so a message's role is bound before its turns are
    named = F.transform(messages, lambda m: F.struct(unescape(F.substring(m[0], len(START) + 1, 1 << 30)).alias("role"), F.split(m[1], r"<\|im_turn\|>").alias("texts")))
    return F.flatten(F.transform(named, lambda m: F.transform(m["texts"], lambda t: F.struct(m["role"].alias("role"), unescape(t).alias("text")))))


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""
    out = formatted(conversations).select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"])), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
