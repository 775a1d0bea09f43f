"""Chat formatting with Spark expressions only, and reading it back.

The output marks turns with control strings that all begin with ``<``:

    <turn user>
    first text<next>second text of the same role</turn>
    <turn assistant>
    answer</turn>

Inside roles and texts no ``<`` is left: a backslash becomes ``\\b``, ``<``
becomes ``\\l``, ``>`` becomes ``\\g`` and, in roles, a line feed becomes
``\\n``.  Every backslash of the output is followed by its letter, so the way
back is three plain replacements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the template
OPEN, MIDDLE, NEXT, CLOSE = "<turn ", ">\n", "<next>", "</turn>\n"
CODES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): one row per conversation.

    Turns are collected as structs and sorted by turn, then role, then text.
    Runs of one role are one block; the texts of a run are joined by a mark
    of their own, so that the way back gives every turn.  One conversation is
    one string, so it is bounded by what a string can hold.

    Defined cases: null role, text: empty; null turn: first; null conv_id: a
    conversation of its own; repeated rows are turns of their own; no rows: no
    conversations; other columns are ignored.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # where a run of one role begins, and where the one after it does
    begins = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    chats = chats.withColumn("begins", begins)
    texts = F.transform("turns", lambda t: escape(t["text"]))
    chats = chats.withColumn("texts", texts)

    def block(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get("begins", k + 1), F.size("turns"))
        run = F.slice("texts", begin + 1, end - begin)
        role = escape_role(F.get("turns", begin)["role"])
        return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), F.array_join(run, NEXT), F.lit(CLOSE))

    return chats.select("conv_id", F.array_join(F.transform("begins", block), "").alias("formatted"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the turns back out of the formatted text, as (role, text)."""
    # the last mark is cut off, as what follows it is no block
    body = F.expr(f"substring(formatted, 1, char_length(formatted) - {len(CLOSE)})")
    parts = F.split(body, "</turn>\n")

    def turns_of(part: Column) -> Column:
        role = F.substring_index(F.substring(part, len(OPEN) + 1, 2**31 - 1), MIDDLE, 1)
        # the role holds no '>' and no line feed, so the first such pair ends it
        texts = F.split(F.substring(part, F.char_length(role) + len(OPEN) + len(MIDDLE) + 1, F.char_length(part)), NEXT)
        return F.transform(
            texts, lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text"))
        )

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(parts, turns_of)).alias("turns"))


def chat_digests(read: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Counts and digests of what was read back."""
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
