"""Chat formatting of typed content parts.

A visitor walks each turn's parts in order. Text is escaped; an image, audio or document part becomes a
placeholder `[kind i]`, i being its place among the conversation's attachments, and leaves a row in
`attachments` with its reference and the tokens it expands to. The template marks turns:

    user       [INST] body [/INST]
    assistant  [ASST] body</s>
    system     [SYS] body [/SYS]
    other      [TURN role] body [/TURN]

Escaping is reversible: `~` `[` `<` `]` become `~0` `~1` `~2` `~3`, so no text can hold a control string and
parsing the output gives back every role and text. The loss mask covers the bodies of assistant turns.

Everything is built-in functions. A conversation is formatted in two steps, blocks of TURNS_A_BLOCK turns first,
so that a conversation with very many turns is formatted by many tasks and only joined at the end. Escaped text has
no raw control character, so these serve as marks on the way: numbering splits a block at the marks of its
attachments and joins it again, in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURNS_A_BLOCK = 64
KINDS = ("image", "audio", "document")
# Tokens that a part without a count of its own expands to.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}
ESCAPES = (("~", "~0"), ("[", "~1"), ("<", "~2"), ("]", "~3"))
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"
# Where a turn begins; placeholders and footers begin otherwise.
TURN = r"(?=\[(?:INST|ASST|SYS|TURN [^\]]*)\] )"
# Marks that no escaped text holds: an attachment, the end of a turn's body, and the end of a placeholder.
FILE, END, CLOSE = "<", "]", "~9"


def escape(c: Column) -> Column:
    for raw, code in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def text_parts(text: Column) -> Column:
    """A plain text as one typed part."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def _header(role: Column) -> Column:
    return (F.when(role == "user", "[INST] ").when(role == "assistant", "[ASST] ").when(role == "system", "[SYS] ")
            .otherwise(F.concat(F.lit("[TURN "), escape(role), F.lit("] "))))


def _footer(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "assistant", "</s>").when(role == "system", " [/SYS]").otherwise(" [/TURN]")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: conv, n_turns, formatted, loss_mask, attachments, expanded_tokens.

    `parts` is array<struct<kind, text, ref, tokens>>. loss_mask lists runs (n_chars, loss) that cover `formatted`
    from its start to its end. attachments lists (place, turn, kind, ref, tokens) in order.

    Null role, text and parts count as empty; a part of unknown kind counts as text. Null turns come first; equal
    turns are ordered by role, then parts, and repeated rows all stay. Null conversation ids form one conversation.
    An empty table gives no rows. Other columns are ignored.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    empty = F.from_json(F.lit("[]"), f"array<{PART}>")
    block = F.coalesce(F.floor(F.col("turn") / TURNS_A_BLOCK), F.lit(-(1 << 62)))
    t = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"),
        F.coalesce(F.col(parts_col), empty).alias("parts"),
    ).withColumn("block", block)
    is_file = lambda p: F.coalesce(p["kind"].isin(*KINDS), F.lit(False))
    flat = F.flatten(F.transform("turns", lambda x: F.transform(F.filter(x["parts"], is_file), lambda p: F.struct(
        x["turn"].alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"),
        F.coalesce(p["tokens"], *[F.when(p["kind"] == k, F.lit(n)) for k, n in DEFAULT_TOKENS.items()]).cast("bigint").alias("tokens")))))
    marked = F.array_join(F.transform("turns", lambda x: F.array_join(F.transform(x["parts"], lambda p: F.when(
        is_file(p), F.lit(FILE)).otherwise(escape(F.coalesce(p["text"], F.lit(""))))), "")), END)
    blocks = t.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns")).select(
        "conv", "block", F.transform("turns", lambda x: x["role"]).alias("roles"), marked.alias("marked"), flat.alias("files"))
    # Places count on over a conversation's blocks.
    before = F.coalesce(F.sum(F.size("files")).over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = F.array_join(F.transform(F.split("marked", FILE), lambda s, i: F.when(F.get("files", i).isNull(), s).otherwise(F.concat(
        s, F.lit("["), F.get("files", i)["kind"], F.lit(" "), (F.col("before") + i).cast("string"), F.lit(CLOSE)))), "")
    bodies = blocks.withColumn("before", before).select("conv", "block", "roles", "files", F.split(numbered, END).alias("bodies"))
    pieces = F.zip_with("roles", "bodies", lambda r, b: F.struct(
        _header(r).alias("head"), F.replace(b, F.lit(CLOSE), F.lit("]")).alias("body"), _footer(r).alias("foot"), (r == "assistant").alias("loss")))
    run = lambda s, loss: F.struct(F.length(s).cast("bigint").alias("n_chars"), loss.alias("loss"))
    shaped = bodies.select("conv", "block", "files", pieces.alias("pieces")).select(
        "conv", "block", "files", F.size("pieces").alias("n"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["foot"])), "").alias("formatted"),
        F.flatten(F.transform("pieces", lambda p: F.array(run(p["head"], F.lit(False)), run(p["body"], p["loss"]), run(p["foot"], F.lit(False))))).alias("mask"))
    convs = shaped.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "n", "formatted", "mask", "files"))).alias("blocks"))
    whole = convs.select(
        "conv", F.aggregate("blocks", F.lit(0).cast("bigint"), lambda s, b: s + b["n"]).alias("n_turns"),
        F.array_join(F.transform("blocks", lambda b: b["formatted"]), "").alias("formatted"),
        F.flatten(F.transform("blocks", lambda b: b["mask"])).alias("loss_mask"), F.flatten(F.transform("blocks", lambda b: b["files"])).alias("files"))
    return whole.select(
        F.col("conv").alias(conv_col), "n_turns", "formatted", "loss_mask",
        F.transform("files", lambda f, i: F.struct(
            i.alias("place"), f["turn"].alias("turn"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate("files", F.lit(0).cast("bigint"), lambda s, f: s + f["tokens"]).alias("expanded_tokens"),
    )


def parse_chats(formatted: Column) -> Column:
    """array<struct<role, body>> read back from a formatted conversation; bodies are unescaped texts with
    placeholders where attachments were. Turns are cut where their headers begin, so no pattern spans a body."""
    turns = F.filter(F.split(formatted, TURN), lambda t: t != "")
    # A header ends with its first `] `; a footer is as long as its role's.
    mark = lambda t: F.substring_index(F.substr(t, F.lit(2)), "]", 1)
    cut = F.transform(turns, lambda t: F.struct(mark(t).alias("mark"), t.alias("t")))
    role = lambda m: (F.when(m == "INST", "user").when(m == "ASST", "assistant").when(m == "SYS", "system")
                      .otherwise(unescape(F.substr(m, F.lit(6)))))
    foot = lambda m: F.when(m == "INST", 8).when(m == "ASST", 4).when(m == "SYS", 7).otherwise(8)
    return F.transform(cut, lambda x: F.struct(role(x["mark"]).alias("role"), unescape(F.substr(
        x["t"], F.length(x["mark"]) + 4, F.length(x["t"]) - F.length(x["mark"]) - 3 - foot(x["mark"]))).alias("body")))


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, from the formatted output alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = chats.select(F.col(conv_col), "formatted", parse_chats(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["body"]), "")
    return read.select(
        conv_col, F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        loss.alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    ).select(
        conv_col, "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
