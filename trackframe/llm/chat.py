"""Chat formatting with a grammar round trip.

A conversation is rendered as one text:

    ### role:\\n        a turn whose text stands as it is, or
    ### role:~\\n       a turn whose text is escaped,
    text</turn>\\n      and its end

The parser splits at every end mark and reads the head up to its first line break; it
knows nothing but the rendered text. Rendering is a loop of at most two steps: render
plainly and reparse; where the turns that come back differ from the source, escape
the turns that hold a control string, and reparse again. Escaped text holds no control
string, so the second parse is identical, which ``round_trip`` states for every row.

Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>"
HEAD = "### "

#: Control strings of a text and what stands for them. The escape sign goes first when escaping and last
#: when undoing it; after it is escaped each sign is followed by its own digit, so no other code can appear by chance.
CODES = (("\\", "\\0"), (END, "\\1"), (HEAD, "\\2"))
#: The same for roles, which also must not end their line early.
ROLE_CODES = (*CODES, ("\n", "\\3"), (":", "\\4"))


def escape(text: Column, codes: tuple = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: tuple = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def conflicts(text: Column) -> Column:
    """The text holds a string that the grammar gives a meaning."""
    return F.contains(text, F.lit(END)) | F.contains(text, F.lit(HEAD))


def _head(turn: Column) -> Column:
    mark = F.when(turn["escaped"], F.lit(":~\n")).otherwise(F.lit(":\n"))
    return F.concat(F.lit(HEAD), escape(turn["role"], ROLE_CODES), mark)


def _body(turn: Column) -> Column:
    return F.when(turn["escaped"], escape(turn["text"])).otherwise(turn["text"])


def render(turns: Column) -> Column:
    """Turns (role, text, escaped) as one text."""
    parts = F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit(f"{END}\n")))
    return F.array_join(parts, "")


def parse(text: Column) -> Column:
    """The turns of a rendered text: array of (role, text, escaped, start, length, byte_start, byte_length).

    ``start`` and ``length`` are where the turn's text stands in the rendered text, escapes included, in code points;
    the other two the same in bytes of UTF-8, by which a text is read without counting through all before it.
    Text that doesn't follow the grammar comes back as turns too, but other ones.
    """
    pieces = F.split(text, f"\\Q{END}\\E\n?")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def read(piece: Column) -> Column:
        line = F.substring_index(piece, "\n", 1)
        marked = F.endswith(line, F.lit(":~"))
        skip = F.length(F.lit(HEAD))
        role = line.substr(skip + 1, F.length(line) - skip - F.when(marked, 2).otherwise(1))
        body = piece.substr(F.length(line) + 2, F.length(piece))
        return F.struct(
            F.length(line).alias("head"),
            F.octet_length(line).alias("head_bytes"),
            unescape(role, ROLE_CODES).alias("role"),
            body.alias("raw"),
            F.when(marked, unescape(body)).otherwise(body).alias("text"),
            marked.alias("escaped"),
        )

    turns = F.transform(pieces, read)
    # Each turn begins after the ones before it; lengths are summed over all but its own text.
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"), F.array().cast("array<struct<at:int,byte:int>>").alias("starts"))

    def step(acc: Column, t: Column) -> Column:
        at, byte = acc["at"] + t["head"] + 1, acc["byte"] + t["head_bytes"] + 1
        return F.struct(
            (at + F.length(t["raw"]) + len(END) + 1).alias("at"),
            (byte + F.octet_length(t["raw"]) + len(END) + 1).alias("byte"),
            F.array_append(acc["starts"], F.struct(at.alias("at"), byte.alias("byte"))).alias("starts"),
        )

    offsets = F.aggregate(turns, zero, step, lambda acc: acc["starts"])
    return F.zip_with(
        turns,
        offsets,
        lambda t, o: F.struct(
            t["role"].alias("role"),
            t["text"].alias("text"),
            t["escaped"].alias("escaped"),
            o["at"].alias("start"),
            F.length(t["raw"]).alias("length"),
            o["byte"].alias("byte_start"),
            F.octet_length(t["raw"]).alias("byte_length"),
        ),
    )


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _with(turns: Column, escaped: Callable[[Column], Column]) -> Column:
    return F.transform(
        turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), escaped(t).alias("escaped"))
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Every conversation as one text, and what its loss covers.

    Returns a row per conv_id: ``formatted``, ``turns`` (read back from it, see ``parse``),
    ``loss_spans`` (start and length in ``formatted`` of each assistant text, in order), ``round_trip`` (the turns that
    came back are the source's; always true) and ``n_escaped``.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have one order; both
    of two repeated rows are kept. A null text or role is an empty one. Rows with a null conv_id are one
    conversation. Other columns are ignored, and an empty table gives an empty result. A conversation is one value
    and so must fit in a row; nothing else is gathered.
    """
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("row"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("source"))
    chats = chats.withColumn("source", _plain(F.col("source")))
    chats = chats.withColumn("first", render(_with(F.col("source"), lambda t: F.lit(False))))
    chats = chats.withColumn("same", _plain(parse(F.col("first"))) == F.col("source"))
    again = render(_with(F.col("source"), lambda t: conflicts(t["text"])))
    chats = chats.withColumn("formatted", F.when(F.col("same"), F.col("first")).otherwise(again))
    chats = chats.withColumn("turns", parse(F.col("formatted")))
    spoken = F.filter("turns", lambda t: t["role"] == "assistant")
    spans = F.transform(spoken, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return chats.select(
        "conv_id",
        "formatted",
        "turns",
        spans.alias("loss_spans"),
        (_plain(F.col("turns")) == F.col("source")).alias("round_trip"),
        F.size(F.filter("turns", lambda t: t["escaped"])).alias("n_escaped"),
    )


def loss_text(formatted: Column, turns: Column) -> Column:
    """The text under the loss mask, unescaped, read from the rendered text's bytes at the spans of the assistant's turns."""

    def read(data: Column) -> Column:
        def one(t: Column) -> Column:
            raw = data.substr(t["byte_start"] + 1, t["byte_length"]).cast("string")
            return F.when(t["escaped"], unescape(raw)).otherwise(raw)

        return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), one), "")

    return F.get(F.transform(F.array(formatted.cast("binary")), read), F.lit(0))
