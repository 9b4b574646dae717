"""Chat formatting in budgeted windows.

Turns are numbered by prefix sums of their tokens, taken over a distributed sort, so a
conversation of any length is spread over tasks.  Windows follow from the sums alone: turns
whose sums fall in the same stretch of ``capacity`` tokens are one window, and a turn
longer than that has one for itself.  Every window begins with the conversation's system turn and
some of the turns before it; such repeats, and all turns but the assistant's, are masked.

``<|im_start|>role\\ntext<|im_end|>\\n`` is a turn.  In texts and roles every backslash is
doubled and ``<|`` becomes ``<\\|``, so no text can look like a marker and both can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import running_total

START, END = "<|im_start|>", "<|im_end|>\n"
# Tokens of a window at most, unless a single turn is longer than it may be.
BUDGET = 1024
# Tokens that a turn's markers and role count for.
OVERHEAD = 4
#: What counts as one token in a text: a run of ASCII letters and digits, or any other visible character.
TOKEN = "[A-Za-z0-9]+|[^A-Za-z0-9\\x00-\\x20]"
# Long turns are counted in the sums' upper bits, tokens of all others in these lower ones: room for 2^27
# long turns and 2^36 tokens in a conversation.  Beyond that the sums overflow, which is an error.
_LOW_BITS = 36


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    """A role is one line: a line end in it becomes <\\n|, which escaping leaves to it alone."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def _plain_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def windows(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per window: conv_id, position, formatted, loss (spans of code points, start and
    exclusive end), n_turns, n_repeated, n_tokens, over_budget.

    ``turns`` has conv_id, turn, role and text; other columns are ignored.  Turns go by turn, null
    first, then role and text; repeated rows are turns of their own, and null roles and texts are
    empty.  Rows without a conv_id are one conversation.  A quarter of the budget each is for the
    system turn, the repeated history and the stretch that a window begins in; a turn may end beyond
    its stretch by as much again.  Only a window that a longer turn stands in is over budget; no text
    is ever cut.  A conversation's system turn is its first turn, if that has the role system.  An empty table
    gives no windows.  A conversation may have 134 million turns longer than a stretch, and 68 billion tokens in others.
    """
    capacity = budget // 4
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long") + OVERHEAD)
    weight = f"CASE WHEN tokens > {capacity} THEN shiftleft(1L, {_LOW_BITS}) ELSE tokens END"
    low = (1 << _LOW_BITS) - 1
    summed = running_total(rows, ["turn ASC NULLS FIRST", "role", "text"], group=["conv_id"], weight=weight, total="upto")
    placed = summed.selectExpr(
        "conv_id", "role", "text", "tokens", "upto", f"upto - ({weight}) AS before", f"tokens > {capacity} AS long").selectExpr(
        "*", f"2 * shiftright(before, {_LOW_BITS}) + CAST(long AS INT) AS part",
        f"CASE WHEN long THEN 0L ELSE CAST(floor((before & {low}) / {capacity}) AS BIGINT) END AS stretch")

    key = ["conv_id", "part", "stretch"]
    spans = placed.groupBy(*key).agg(F.min("before").alias("first"), F.max("upto").alias("last"))
    system = placed.where("before = 0 AND role = 'system'")
    # A window is followed by the one that begins at its last sum: its last turns are that one's history.
    following = spans.selectExpr("conv_id", "part AS next_part", "stretch AS next_stretch", "first AS last")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ends = spans.join(following.withColumnRenamed("conv_id", "c").withColumnRenamed("last", "l"),
                      same("conv_id", "c") & same("last", "l")).drop("c", "l")
    tail = ends.selectExpr("conv_id AS c", "part AS p", "stretch AS s", "last", "next_part", "next_stretch")
    history = placed.join(tail, same("conv_id", "c") & same("part", "p") & same("stretch", "s")).where(
        f"last - before <= {capacity} AND NOT (before = 0 AND role = 'system')").selectExpr(
        "conv_id", "next_part AS part", "next_stretch AS stretch", "before", "role", "text", "tokens", "true AS repeated")
    kept = spans.where("first > 0").selectExpr("conv_id AS c", "part", "stretch").join(
        system.drop("part", "stretch"), same("c", "conv_id")).selectExpr(
        "conv_id", "part", "stretch", "before", "role", "text", "tokens", "true AS repeated")
    own = placed.selectExpr(*key, "before", "role", "text", "tokens", "false AS repeated")

    told = own.unionByName(history).unionByName(kept).select(
        *key, "tokens", F.struct(
            "before", "repeated", ((F.col("role") == "assistant") & ~F.col("repeated")).alias("counts"),
            F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("text")).alias("t"))
    # A window holds at most a budget's worth of turns, or one long turn and its context.
    joined = told.groupBy(*key).agg(F.array_sort(F.collect_list("t")).alias("t"), F.sum("tokens").alias("n_tokens"))
    end = len(END)
    loss = ("aggregate(t, named_struct('at', 0, 'out', CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)), (done, x) -> named_struct("
            f"'at', done.at + char_length(x.head) + char_length(x.text) + {end}, 'out', CASE WHEN x.counts THEN concat(done.out, array(named_struct("
            "'start', done.at + char_length(x.head), 'end', done.at + char_length(x.head) + char_length(x.text)))) ELSE done.out END), done -> done.out)")
    return joined.select(
        "conv_id", F.expr("array_min(filter(t, x -> NOT x.repeated).before)").alias("position"),
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "").alias("formatted"),
        F.expr(loss).alias("loss"), F.size("t").alias("n_turns"),
        F.size(F.filter("t", lambda x: x["repeated"])).alias("n_repeated"), "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What windows hold: conv_id, position, turns (structs of role and text, repeats left out) and
    loss_texts, the texts under the window's mask, all unescaped."""
    # Markers can't occur in escaped texts, so the text is cut at them.
    pieces = F.split("formatted", "<\\|im_end\\|>\n", -1)
    own = F.expr("slice(pieces, n_repeated + 1, n_turns - n_repeated)")
    return formatted.select("*", pieces.alias("pieces")).select(
        "conv_id", "position", F.transform(own, lambda p: F.struct(
            _plain_role(F.substring_index(F.substring(p, F.lit(len(START) + 1), F.length(p)), "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(
            F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))).alias("loss_texts"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation the digests of what is read back from its windows, a written table.

    A digest is over all of a conversation in one order, so its texts meet in one row here."""
    told = read_back(formatted)
    each = told.select(
        "conv_id", "position", F.size("turns").cast("long").alias("n"), F.array_join("loss_texts", "").alias("loss"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"))
    joined = each.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("position", "said", "loss"))).alias("x"))
    sizes = formatted.groupBy(F.col("conv_id").alias("c")).agg(F.sum(F.char_length("formatted").cast("long")).alias("formatted_chars"))
    loss = F.array_join("x.loss", "")
    return joined.join(sizes, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "n_turns", F.sha2(F.array_join("x.said", ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
