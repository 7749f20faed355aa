"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn := "<<SYS>>\\n" text "\\n<</SYS>>\\n\\n"          system
          | "<s>[INST] " text " [/INST]"                  user
          | " " text " </s>"                              assistant
          | "<<ROLE>>" role "<<:>>" text "<</ROLE>>"       any other role

A turn ends at the first closing string, so parsing is deterministic.  A conversation is rendered as it is, parsed,
and compared with its source; where they differ the texts that hold control strings are escaped, and where they still
differ all texts are.  Escaped text holds no ``<`` and no ``[``, so no control string: the last step always agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing string by role.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER = ("<<ROLE>>", "<<:>>", "<</ROLE>>")
#: What may stand for something else when read back.
CONTROL = r"<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]|<</?ROLE>>|<<:>>|\\[123]"
RAW_CONTROL = CONTROL.removesuffix(r"|\\[123]")
TURN = r"(?s).*?(?: \[/INST\]| </s>|\n<</SYS>>\n\n|<</ROLE>>)"
ESCAPES = (("\\", "\\1"), ("[", "\\2"), ("<", "\\3"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def rendered(turns: Column, level: int) -> Column:
    """Level 0 leaves texts as they are, 1 escapes those with control strings, 2 escapes all."""

    def shown(x: Column) -> Column:
        return x if level == 0 else escaped(x) if level == 2 else F.when(x.rlike(CONTROL), escaped(x)).otherwise(x)

    def turn(t: Column) -> Column:
        text = shown(t["text"])
        out = F.concat(F.lit(OTHER[0]), shown(t["role"]), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
        for role, (opening, closing) in MARKS.items():
            out = F.when(t["role"] == role, F.concat(F.lit(opening), text, F.lit(closing))).otherwise(out)
        return out

    return F.array_join(F.transform(turns, turn), "")


def turn_strings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TURN), F.lit(0))


def _inside(chunk: Column, opening: str, closing: str) -> Column:
    return F.substring(chunk, F.lit(len(opening) + 1), F.char_length(chunk) - len(opening) - len(closing))


def parsed(text: Column) -> Column:
    """Array of (role, text) read from a formatted conversation; a text with a bare control string is malformed: null."""

    def content(inner: Column) -> Column:
        return F.when(~inner.rlike(RAW_CONTROL), unescaped(inner))

    def turn(chunk: Column) -> Column:
        body = _inside(chunk, OTHER[0], OTHER[2])
        out = F.struct(
            unescaped(F.substring_index(body, OTHER[1], 1)).alias("role"),
            content(F.substring(body, F.char_length(F.substring_index(body, OTHER[1], 1)) + len(OTHER[1]) + 1, F.char_length(body))).alias("text"),
        )
        for role, (opening, closing) in MARKS.items():
            out = F.when(chunk.endswith(closing), F.struct(F.lit(role).alias("role"), content(_inside(chunk, opening, closing)).alias("text"))).otherwise(out)
        return out

    return F.transform(turn_strings(text), turn)


def loss_spans(text: Column) -> Column:
    """Code-point spans [start, stop) of the assistant texts in a formatted conversation."""
    opening, closing = MARKS["assistant"]
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))

    def step(acc: Column, chunk: Column) -> Column:
        stop = acc["at"] + F.char_length(chunk)
        span = F.struct((acc["at"] + len(opening)).alias("start"), (stop - len(closing)).alias("stop"))
        return F.struct(stop.alias("at"), F.when(chunk.endswith(closing), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turn_strings(text), start, step, lambda acc: acc["spans"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): a row per conversation of ``turns`` (conv_id, turn, role, text).

    Rows go by turn, ties by role, then text; repeated rows are turns of their own; a null turn comes first; null
    texts and roles are empty; a null conv_id is a conversation too; other columns are not read.  One conversation's
    text is one value, so a conversation must fit a task.
    """
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    out = out.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"))
    out = out.withColumn("formatted", rendered(F.col("source"), 0)).withColumn("agrees", F.lit(False))
    for level in (1, 2):  # what agrees is not parsed again
        out = out.withColumn("agrees", F.col("agrees") | (parsed(F.col("formatted")) == F.col("source")))
        out = out.withColumn("formatted", F.when(F.col("agrees"), F.col("formatted")).otherwise(rendered(F.col("source"), level)))
    return out.select("conv_id", "formatted", loss_spans(F.col("formatted")).alias("loss_spans"))


#: Spans that are cut together out of the whole text; each is then cut out of that piece.
SPANS = 256


def masked_text(text: Column, spans: Column) -> Column:
    """The unescaped text under ascending spans, nothing between.

    A code point is found by reading a string from its beginning, so spans are cut from pieces of SPANS of them.
    """

    def piece(at: Column) -> Column:
        own = F.slice(spans, at + 1, SPANS)
        first, last = F.element_at(own, 1), F.element_at(own, -1)
        cut = F.array(F.substring(text, first["start"] + 1, last["stop"] - first["start"]))
        return F.array_join(F.flatten(F.transform(cut, lambda p: F.transform(own, lambda s: unescaped(F.substring(p, s["start"] - first["start"] + 1, s["stop"] - s["start"]))))), "")

    begin = F.sequence(F.lit(0), F.size(spans) - 1, F.lit(SPANS))
    return F.when(F.size(spans) > 0, F.array_join(F.transform(begin, piece), "")).otherwise(F.lit(""))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its loss mask say, read back from them."""
    text = F.col("formatted")
    learnt = masked_text(text, F.col("loss_spans"))
    out = formatted.select("conv_id", parsed(text).alias("turns"), learnt.alias("learnt"), F.char_length(text).cast("long").alias("formatted_chars"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


PLANTED = """select -7L as conv_id, 0L as turn, 'user' as role, '</s>[INST] ok [/INST]' as text
union all select -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'"""

#: DuckDB SQL for the digests of all conversations and the planted one.
ORACLE = r"""
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), odd as (
  select *, regexp_matches(text, '<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]|<</?ROLE>>|<<:>>|\\[123]') as hard from given
)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  cast(sum(case role when 'system' then 19 when 'user' then 18 when 'assistant' then 6 else 22 + length(role) end + length(text)
    + case when hard then length(text) - length(replace(replace(replace(text, '\', ''), '[', ''), '<', '')) else 0 end) as bigint) as formatted_chars
from odd group by conv_id
"""
