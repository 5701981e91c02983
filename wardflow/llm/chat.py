"""Chat formatting with a grammar round trip, in built-in functions only.

A turn is ``open text close``; turns are joined by a line break.  Text is first
rendered as it is and read back by a deterministic parser: control strings split
the text, and marks and bodies must alternate as the grammar says.  Where the
recovered turns differ from the source, the turns that hold control strings or
escape codes are escaped and the whole is tried again; if that should still
differ, every turn is escaped.  Escaped text holds no control string at all, so
the last form always reads back.

Defined cases: a null text is empty; a null role is the empty role; turns are
ordered by turn number (null first), then role, then text, so repeated rows are
turns of their own; rows with a null id form one conversation; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Opening and closing marks of the known roles.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
CONTROL = r"\[/?INST\]|</?s>|<</?SYS>>|\[ROLE [^\[\]<>]*\]|\[/ROLE\]"
#: Escape codes; the escape character itself is undone last.
CODES = (("<", "\\3c"), ("[", "\\5b"), (">", "\\3e"), ("]", "\\5d"))
CODED = r"\\(?:3c|5b|3e|5d|5c)"


def escape(text: Column, every: bool = False) -> Column:
    """Text without ``\\``, ``<`` and ``[`` (and ``>`` and ``]`` if ``every``)."""
    out = F.replace(text, F.lit("\\"), F.lit("\\5c"))
    for raw, code in CODES if every else CODES[:2]:
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    for raw, code in CODES:
        text = F.replace(text, F.lit(code), F.lit(raw))
    return F.replace(text, F.lit("\\5c"), F.lit("\\"))


def _marks(role: Column, which: int) -> Column:
    other = F.concat(F.lit("[ROLE "), escape(role, every=True), F.lit("]")) if which == 0 else F.lit("[/ROLE]")
    out = F.when(F.lit(False), "")
    for name, marks in MARKS.items():
        out = out.when(role == name, marks[which])
    return out.otherwise(other)


def _render(turns: Column, escaped) -> Column:
    """``escaped(text)`` says whether a turn's text is escaped."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        _marks(t["role"], 0), F.lit(" "),
        F.when(escaped(t["text"]), escape(t["text"])).otherwise(t["text"]),
        F.lit(" "), _marks(t["role"], 1))), "\n")


def parse(formatted: Column) -> Column:
    """Array of ``(role, text, body)`` recovered from a rendered text, null where the grammar does not hold.

    ``body`` is the text as it stands between the marks.
    """
    def read(parts: Column) -> Column:
        marks, bodies = parts["marks"], parts["bodies"]
        n = F.floor(F.size(marks) / 2).cast("int")

        def turn(i: Column) -> Column:
            start, end, body = F.get(marks, 2 * i), F.get(marks, 2 * i + 1), F.get(bodies, 2 * i + 1)
            role, close = F.when(F.lit(False), ""), F.when(F.lit(False), "")
            for name, (a, b) in MARKS.items():
                role, close = role.when(start == a, name), close.when(start == a, b)
            named = start.startswith("[ROLE ")
            role = role.when(named, unescape(F.substr(start, F.lit(7), F.length(start) - 7)))
            close = close.when(named, "[/ROLE]")
            inner = F.substr(body, F.lit(2), F.length(body) - 2)
            ok = (close == end) & (F.length(body) >= 2) & body.startswith(" ") & body.endswith(" ") & (
                F.get(bodies, 2 * i) == F.when(i == 0, "").otherwise("\n"))
            return F.when(ok, F.struct(role.alias("role"), unescape(inner).alias("text"), inner.alias("body")))

        whole = (F.size(marks) % 2 == 0) & (F.size(marks) > 0) & (F.element_at(bodies, -1) == "")
        return F.when(whole, let(F.transform(F.sequence(F.lit(0), n - 1), turn),
                                 lambda t: F.when(~F.exists(t, lambda x: x.isNull()), t)))

    return let(F.struct(F.regexp_extract_all(formatted, F.lit(CONTROL), 0).alias("marks"),
                        F.split(formatted, CONTROL, -1).alias("bodies")), read)


def _same(parsed: Column, turns: Column) -> Column:
    plain = lambda x: F.transform(x, lambda t: F.struct(t["role"], t["text"]))
    return F.coalesce(plain(parsed) == plain(turns), F.lit(False))


def _spans(parsed: Column) -> Column:
    """(start, length) of the assistant bodies, in characters of the rendered text."""
    def add(state: Column, t: Column) -> Column:
        open_at = state["at"] + F.length(_marks(t["role"], 0)) + 1
        size = F.length(t["body"])
        span = F.array(F.struct(open_at.alias("start"), size.alias("length")))
        return F.struct(
            (open_at + size + 1 + F.length(_marks(t["role"], 1)) + 1).alias("at"),
            F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    empty = F.array().cast("array<struct<start:int,length:int>>")
    return F.aggregate(parsed, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add)["spans"]


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row a conversation: ``conv_id, formatted, turns, loss_spans``.

    ``turns`` is read back from ``formatted``; ``loss_spans`` are the character
    spans that a model is trained on, the assistant's texts as formatted.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("source"))
    src = F.col("source")
    conflict = lambda text: text.rlike(f"{CONTROL}|{CODED}")

    def attempt(form: Column, otherwise: Column) -> Column:
        return let(form, lambda f: F.when(_same(parse(f), src), f).otherwise(otherwise))

    formatted = attempt(_render(src, lambda t: F.lit(False)),
                        attempt(_render(src, conflict), _render(src, lambda t: F.lit(True))))
    read = grouped.select("conv_id", "source", formatted.alias("formatted")).select(
        "conv_id", "source", "formatted", parse(F.col("formatted")).alias("turns"))
    checked = F.when(_same(F.col("turns"), src), F.col("turns")).otherwise(
        F.raise_error(F.lit("a formatted conversation does not read back")).cast(
            "array<struct<role:string,text:string,body:string>>"))
    return read.select("conv_id", "formatted", checked.alias("turns")).select(
        "conv_id", "formatted", "turns", _spans(F.col("turns")).alias("loss_spans"))
