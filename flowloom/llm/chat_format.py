"""Chat formatting with DataFrame functions only.

A turn is a list of typed parts (text, image, audio, document). Visiting them in order gives the turn's content: text
is escaped, any other part becomes a placeholder and an attachment record with the tokens it expands to. Turns are
marked by their role and joined in order; the loss mask lists the assistant's text spans.

Template: a turn is ``<s>`` content ``</s>``; a user's content stands in ``[INST]``/``[/INST]``, a system's in
``[SYS]``/``[/SYS]``, any other role but the assistant's is named before it in ``[ROLE]``/``[/ROLE]``. Escaping puts a
backslash behind the first character of a control string, and one more behind those that have some already, so it can
be undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_NAME = r"(/?(?:s|INST|SYS|ROLE|image|audio|document)[>\]])"
#: Tokens of one unit of a part: an image tile, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 576, "audio": 25, "document": 512}
PART = "struct<kind:string,text:string,ref:string,units:double>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _NAME, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _NAME, r"$1$2$3")


def text_parts(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def _is_text(p: Column) -> Column:
    return ~F.coalesce(p["kind"], F.lit("text")).isin(*UNIT_TOKENS)


def _visit(p: Column) -> Column:
    """A part's place in the content. Kinds other than the four count as text; a null text is empty."""
    out = escape(F.coalesce(p["text"], F.lit("")))
    return F.when(_is_text(p), out).otherwise(F.concat(F.lit("<"), p["kind"], F.lit(">")))


def _tokens(p: Column) -> Column:
    each = F.lit(0)
    for kind, n in UNIT_TOKENS.items():
        each = F.when(p["kind"] == kind, n).otherwise(each)
    return F.ceil(F.greatest(F.coalesce(p["units"], F.lit(1.0)), F.lit(0.0)) * each).cast("bigint")


def format_turns(messages: DataFrame) -> DataFrame:
    """Per row of ``messages`` (conv_id, turn, role, parts): its ``piece`` of the output, spans inside it, attachments."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    opening = F.when(role == "assistant", "<s>").when(role == "user", "<s>[INST]").when(role == "system", "<s>[SYS]").otherwise(
        F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]"))
    )
    closing = F.when(role == "user", "[/INST]</s>").when(role == "system", "[/SYS]</s>").otherwise("</s>")
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    m = messages.select("conv_id", "turn", role.alias("role"), parts.alias("parts"), opening.alias("opening"), closing.alias("closing"))
    m = m.withColumn("bits", F.transform("parts", _visit))
    # offsets of the parts: running sums of their lengths
    sums = F.aggregate("bits", F.array(F.length("opening").cast("bigint")), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + F.length(b))))
    m = m.withColumn("at", sums)
    spans = F.filter(
        F.transform("parts", lambda p, i: F.struct(F.get("at", i).alias("start"), F.length(F.get("bits", i)).cast("bigint").alias("size"), _is_text(p).alias("text"))),
        lambda s: s["text"] & (s["size"] > 0),
    )
    loss = F.when(F.col("role") == "assistant", F.transform(spans, lambda s: F.struct("turn", s["start"].alias("start"), s["size"].alias("size"))))
    files = F.filter(
        F.transform("parts", lambda p, i: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), F.get("at", i).alias("start"), _tokens(p).alias("tokens"))),
        lambda a: F.coalesce(a["kind"], F.lit("text")).isin(*UNIT_TOKENS),
    )
    none = F.array().cast("array<struct<turn:bigint,start:bigint,size:bigint>>")
    return m.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.concat("opening", F.array_join("bits", ""), "closing").alias("piece"),
        F.coalesce(loss.cast("array<struct<turn:bigint,start:bigint,size:bigint>>"), none).alias("spans"), files.alias("files"),
    )


def format_chats(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_spans``, ``attachments``, ``expanded_tokens``, ``n_turns``.

    ``messages`` has conv_id, turn, role and parts (``array<PART>``); other columns are not read. Turns stand by
    ``turn`` (null first); rows of one turn, repeated ones too, all stay, in the order of their output. A null role is
    the empty role, null parts are an empty turn, null conversation ids are one conversation. ``loss_spans`` gives, for
    each text part of the assistant, the 0-based turn number, the start in that turn and in ``formatted``, and the size,
    in code points; attachments are placed likewise. A conversation is one output row, so it must fit one task.
    """
    turns = format_turns(messages)
    order = W.partitionBy("conv_id").orderBy("turn", "piece")
    before = F.sum(F.length("piece").cast("bigint")).over(order.rowsBetween(W.unboundedPreceding, -1))
    turns = turns.withColumns({"no": F.row_number().over(order) - 1, "base": F.coalesce(before, F.lit(0).cast("bigint"))})
    row = F.struct(
        "no", "piece",
        F.transform("spans", lambda s: F.struct(F.col("no").alias("turn_no"), s["start"].alias("start"), s["size"].alias("size"), (s["start"] + F.col("base")).alias("at"))).alias("spans"),
        F.transform("files", lambda a: F.struct(a["kind"], a["ref"], a["tokens"], F.col("no").alias("turn_no"), a["start"].alias("start"), (a["start"] + F.col("base")).alias("at"))).alias("files"),
    )
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row), lambda a, b: a["no"] - b["no"]).alias("r"))
    files = F.flatten(F.transform("r", lambda t: t["files"]))
    return chats.select(
        "conv_id", F.size("r").cast("bigint").alias("n_turns"), F.array_join(F.transform("r", lambda t: t["piece"]), "").alias("formatted"),
        F.flatten(F.transform("r", lambda t: t["spans"])).alias("loss_spans"), files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def split_turns(formatted: Column) -> Column:
    """The marked turns of a formatted conversation: an unescaped ``<s>`` starts each one."""
    return F.filter(F.split(formatted, "(?=<s>)", -1), lambda t: t != "")


def read_turn(turn: Column) -> Column:
    """Role and text of a marked turn, unescaped."""
    inner = F.substr(turn, F.lit(4), F.length(turn) - 7)

    def within(name: str) -> Column:
        return F.substr(inner, F.lit(len(name) + 3), F.length(inner) - (2 * len(name) + 5))

    named = F.regexp_extract(inner, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)
    role = F.when(inner.startswith("[INST]"), "user").when(inner.startswith("[SYS]"), "system").when(inner.startswith("[ROLE]"), unescape(named)).otherwise("assistant")
    text = F.when(inner.startswith("[INST]"), within("INST")).when(inner.startswith("[SYS]"), within("SYS")).when(
        inner.startswith("[ROLE]"), F.substr(inner, F.length(named) + 14)
    ).otherwise(inner)
    return F.struct(role.alias("role"), unescape(text).alias("text"))


def chat_digest(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and text under the loss mask."""
    c = chats.withColumn("turns", split_turns(F.col("formatted")))
    lines = F.transform("turns", lambda t: F.concat_ws("\n", read_turn(t)["role"], read_turn(t)["text"], F.lit("")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.get("turns", s["turn_no"]), (s["start"] + 1).cast("int"), s["size"].cast("int")))), "")
    c = c.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.array_join(lines, "").alias("lines"), loss.alias("loss"), "formatted")
    return c.select(
        "conv_id", "n_turns", F.sha2("lines", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
