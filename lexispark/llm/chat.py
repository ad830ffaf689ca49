r"""Chat formatting by a grammar round trip, in built-in functions only.

A turn is rendered as ``### <role>:\n<text></turn>\n``. The grammar of a rendered conversation is
``("### " role ":\n" text "</turn>\n")*`` in which neither ``###`` nor ``</turn>`` may occur inside role or text; the
parser cuts at these marks and undoes escapes (a backslash makes the next character plain). A conversation is first
rendered as it is and parsed again. Where the turns read back differ from the source, each turn that does not survive on
its own is escaped, which makes the round trip identical.

Defined results: null text or role: empty; null conversation ids form one conversation; turns with equal numbers are
ordered by role, then text; null turn numbers come first; repeated rows are repeated turns. One conversation is one output
row, so a conversation must fit into a task; conversations are otherwise independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import let

HEAD, COLON, END = "### ", ":\n", "</turn>\n"
LEARNED_ROLE = "assistant"
PROBE = r"\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    r"""Backslashes are doubled, ``##`` becomes ``#\#`` and ``</turn>`` becomes ``<\/turn>``; line ends and colons (of roles) become ``\n`` and ``\:``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("##"), F.lit("#\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(COLON), text, F.lit(END))


def _marked(rendered: Column) -> Column:
    """What follows each mark of a turn."""
    return let(F.split(rendered, "###", -1), lambda x: F.slice(x, F.lit(2), F.size(x)))


def parse(rendered: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation. Anything outside the grammar gives other turns than those rendered, never an error."""
    pieces = _marked(rendered)

    def turn(piece: Column) -> Column:
        # the first ":\n" that no backslash guards ends the role; role escapes leave none before it
        role = F.substring_index(piece, COLON, 1)
        rest = F.substr(piece, F.length(role) + 3)
        return F.struct(unescape(F.substr(role, F.lit(2))).alias("role"), unescape(F.substring_index(rest, END.rstrip("\n"), 1)).alias("text"))

    return F.transform(pieces, turn)


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, ``formatted`` string, and ``loss_mask``: array of struct<turn, start, length> in order, one for each
    assistant turn: its text is ``length`` code points from the ``start``-th after the ``###`` mark of turn ``turn`` began (from 0)."""
    rows = df.select(
        df[conv_id].cast("long").alias("conv_id"),
        F.struct(df[turn].cast("long").alias("turn"), F.coalesce(df[role], F.lit("")).alias("role"), F.coalesce(df[text], F.lit("")).alias("text")).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def survives(t: Column) -> Column:
        back = parse(render_turn(t["role"], t["text"]))
        return (F.size(back) == 1) & F.coalesce((F.get(back, F.lit(0))["role"] == t["role"]) & (F.get(back, F.lit(0))["text"] == t["text"]), F.lit(False))

    def escaped(t: Column) -> Column:
        fits = survives(t)
        return F.struct(
            F.when(fits, t["role"]).otherwise(escape_role(t["role"])).alias("role"),
            F.when(fits, t["text"]).otherwise(escape(t["text"])).alias("text"),
            (t["role"] == LEARNED_ROLE).alias("learned"),
        )

    def joined(parts: Column) -> Column:
        return F.concat_ws("", F.transform(parts, lambda p: render_turn(p["role"], p["text"])))

    plain = turns.withColumn("raw", joined(F.col("turns")))
    back = parse(F.col("raw"))
    same = back == F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    as_is = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["role"] == LEARNED_ROLE).alias("learned")))
    parts = plain.select("conv_id", F.when(same, as_is).otherwise(F.transform("turns", escaped)).alias("parts"))
    spans = F.transform(
        F.filter(F.transform("parts", lambda p, i: F.struct(p["role"].alias("role"), p["text"].alias("text"), p["learned"].alias("learned"), i.alias("i"))), lambda p: p["learned"]),
        lambda p: F.struct(p["i"].alias("turn"), (F.length(p["role"]) + len(HEAD + COLON)).alias("start"), F.length(p["text"]).alias("length")),
    )
    return parts.select("conv_id", joined(F.col("parts")).alias("formatted"), spans.alias("loss_mask"))


def read_back(df: DataFrame) -> DataFrame:
    """Turns and learned text as a reader of ``formatted`` and ``loss_mask`` finds them."""
    marked = _marked(F.col("formatted"))

    def under(pieces: Column) -> Column:
        return F.concat_ws("", F.transform("loss_mask", lambda s: unescape(F.substr(F.get(pieces, s["turn"]), s["start"] - 2, s["length"]))))

    learned = let(marked, under)
    return df.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), learned.alias("learned"))


def digest(df: DataFrame) -> DataFrame:
    back = read_back(df)
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(df: DataFrame) -> DataFrame:
    """The table with conversation -7, which says the template's own marks."""
    probe = df.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED_ROLE).alias("role"), F.lit(PROBE).alias("text")
    )
    return df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
