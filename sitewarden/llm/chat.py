"""Chat formatting with typed content parts, in DataFrame functions alone.

A conversation is a set of turns; a turn has a role and an ordered array of parts, each (type, text, uri, units). A
visitor renders the parts by their types: each run of neighbouring texts is joined, escaped and kept, an image, audio or
document part becomes a placeholder, is recorded as an attachment and counts for `units` x its rate of tokens. The
template is

    <|im_start|>ROLE\\n BODY <|im_end|>\\n        (without the blanks)

and every control string inside texts and roles is escaped: `<`, any backslashes, `|` gets one backslash more, which
unescape() takes away again, so that no text can forge a turn, nor can neighbouring texts that are harmless alone.
read_back() tells placeholders from texts that only look like them and gives the parts again.

Defined cases: a null conversation id is a conversation of its own; a null role or text is empty; null parts are no
parts; unknown part types are rendered as text; turns sort by (turn, role, body), nulls first, and repeated rows
stay; a conversation without an assistant has an empty mask; an empty table gives an empty result. The unit of work
is a conversation, since its formatted text is one value: turns are rendered, escaped and measured row by row before
they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens that one unit of an attachment expands to: an image tile, a second of audio, a page of a document.
RATES = {"image": 256, "audio": 25, "document": 700}
PARTS = "array<struct<type:string,text:string,uri:string,units:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def is_file(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*RATES), F.lit(False))


def render(parts: Column) -> Column:
    """The visitor: what a turn's parts leave in its body; a run of texts is one text, whatever its parts."""
    files = F.filter(F.transform(parts, lambda p, i: F.when(is_file(p), i)), lambda i: i.isNotNull())
    ends = F.concat(F.array(F.lit(-1)), files, F.array(F.size(parts)))

    def run(i: Column) -> Column:
        before, after = ends[i], ends[i + 1]
        texts = F.transform(F.slice(parts, before + 2, after - before - 1), lambda p: F.coalesce(p["text"], F.lit("")))
        mark = F.when(after < F.size(parts), F.concat(F.lit("<|"), F.get(parts, after)["type"], F.lit("|>"))).otherwise("")
        return F.concat(escape(F.array_join(texts, "")), mark)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(files)), run), "")


def expand(part: Column) -> Column:
    """The visitor: the tokens that a part's placeholder expands to, null for text."""
    out = F.lit(None).cast("bigint")
    for kind, rate in RATES.items():
        out = F.when(part["type"] == kind, F.coalesce(part["units"], F.lit(1)) * rate).otherwise(out)
    return out


def text_parts(text: Column) -> Column:
    """A plain text as the parts of a turn."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("bigint").alias("units"))
    return F.array(part)


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    loss_spans: for each turn of the role `learn`, in order, (turn_index, turn_start, start, length) in code points of
    formatted; the span is the body without the template. attachments: (ordinal, turn_index, type, uri, tokens).
    """
    bits = F.filter(F.coalesce(F.col(parts).cast(PARTS), F.array().cast(PARTS)), lambda p: p.isNotNull())
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), bits.alias("_bits"))
    rows = rows.select(
        "conv_id", "_turn", "_role",
        render(F.col("_bits")).alias("_body"),
        F.transform(F.filter("_bits", is_file), lambda p: F.struct(p["type"].alias("type"), p["uri"].alias("uri"), expand(p).alias("tokens"))).alias("_files"),
    )
    rows = rows.withColumn("_head", F.concat(F.lit(START), escape_role(F.col("_role")), F.lit("\n")))
    rows = rows.withColumn("_chars", (F.length("_head") + F.length("_body") + len(END)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "conv_id", "_role", "_files", "_chars",
        F.concat("_head", "_body", F.lit(END)).alias("_piece"),
        F.length("_head").alias("_head_chars"),
        F.length("_body").cast("long").alias("_body_chars"),
        (F.row_number().over(order) - 1).alias("_index"),
        F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_start"),
        F.coalesce(F.sum(F.size("_files")).over(before), F.lit(0)).alias("_file0"),
    )
    span = F.struct(F.col("_index").alias("turn_index"), F.col("_start").alias("turn_start"), (F.col("_start") + F.col("_head_chars")).alias("start"), F.col("_body_chars").alias("length"))
    files = F.transform("_files", lambda f, i: F.struct((F.col("_file0") + i).alias("ordinal"), F.col("_index").alias("turn_index"), f["type"].alias("type"), f["uri"].alias("uri"), f["tokens"].alias("tokens")))
    whole = rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("_index", "_piece"))).alias("_pieces"),
        F.sort_array(F.collect_list(F.when(F.col("_role") == learn, span))).alias("loss_spans"),
        F.flatten(F.sort_array(F.collect_list(files))).alias("attachments"),
    )
    return whole.select(
        "conv_id", "n_turns",
        F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "").alias("formatted"),
        "loss_spans", "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, f: n + f["tokens"]).alias("expanded_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text, parts), loss_texts and formatted_chars, parsed from formatted and loss_spans alone. A
    turn's parts are (type, text): its placeholders, without a text, and the texts between them, empty ones left out."""
    files = rf"<\|({'|'.join(RATES)})\|>"
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2147483647)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END))
        texts = F.transform(F.split(body, files), lambda t: F.struct(F.lit("text").alias("type"), unescape(t).alias("text")))
        marks = F.transform(F.regexp_extract_all(body, F.lit(files), F.lit(1)), lambda m: F.struct(m.alias("type"), F.lit(None).cast("string").alias("text")))
        parts = F.flatten(F.transform(F.arrays_zip(texts.alias("t"), marks.alias("m")), lambda z: F.filter(F.array(z["t"], z["m"]), lambda p: p.isNotNull() & (F.coalesce(p["text"], F.lit("-")) != ""))))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"), parts.alias("parts"))

    def masked(span: Column) -> Column:
        piece = F.element_at(F.col("_pieces"), span["turn_index"] + 1)
        first = (span["start"] - span["turn_start"] - len(START) + 1).cast("int")
        return unescape(F.substring(piece, first, span["length"].cast("int")))

    return chats.withColumn("_pieces", pieces).select(
        "conv_id",
        F.transform("_pieces", turn).alias("turns"),
        F.transform("loss_spans", masked).alias("loss_texts"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
