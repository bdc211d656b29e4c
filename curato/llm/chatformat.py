"""Chat formatting with a grammar round trip, with DataFrame functions only.

A turn is written as ``### role: text</turn>`` and a line end. A deterministic parser cuts the written text wherever a
turn may begin or has ended and takes each piece by the grammar

    turn := "### " role ":" [ "\\" ] " " text "</turn>" newline

in which neither role nor text holds ``### `` or ``</turn>``, and the role no colon. A turn is first written as it is
and parsed: if not just this turn comes back, it conflicts with the grammar and is written with escapes, which the
backslash in its header tells. Then the whole conversation is parsed and compared with its source; where it differs
all of its turns are escaped, and one that still differs is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curato.llm.common import materialise

OPEN, CLOSE, END = "### ", "</turn>", "\n"
LOSS_ROLE = "assistant"
#: What conflicts with the grammar and how it is written; the backslash comes first, and last when it is read.
ESCAPES = (("\\", "\\b"), (OPEN, "\\h## "), (CLOSE, "\\l/turn>"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
_READ = (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\"))
#: Where a turn has ended and where one may begin.
_CUT = f"(?<={CLOSE}{END})|(?={OPEN})"
_TURN = f"(?s)\\A{OPEN}([^:]*):(\\\\?) (.*){CLOSE}{END}\\z"
#: The added conversation, whose texts look like the template.
PROBE_ID, PROBE = -7, "\\### Assistant: </turn> ok"


def escape(value: Column, escapes=ESCAPES) -> Column:
    """The text with what conflicts with the grammar replaced; ``unescape`` gives it back."""
    for plain, written in escapes:
        value = F.replace(value, F.lit(plain), F.lit(written))
    return value


def unescape(value: Column) -> Column:
    """What ``escape`` was given. Each backslash of an escaped text begins an escape, so that no two of them overlap."""
    for written, plain in _READ:
        value = F.replace(value, F.lit(written), F.lit(plain))
    return value


def render(role: Column, text: Column, escaped: Column) -> Column:
    """A turn as it is written; with ``escaped``, by its escapes."""
    plain = F.concat(F.lit(OPEN), role, F.lit(": "), text, F.lit(CLOSE + END))
    safe = F.concat(F.lit(OPEN), escape(role, ROLE_ESCAPES), F.lit(":\\ "), escape(text), F.lit(CLOSE + END))
    return F.when(escaped, safe).otherwise(plain)


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; a null in the place of a piece that isn't a turn."""
    return F.transform(turn_pieces(formatted), _read)


def turn_pieces(formatted: Column) -> Column:
    """The written turns of a formatted conversation."""
    return F.filter(F.split(formatted, _CUT, -1), lambda piece: piece != "")


def _read(piece: Column) -> Column:
    part = lambda i: F.regexp_extract(piece, _TURN, i)
    role, escaped, text = part(1), part(2) != "", part(3)
    fine = piece.rlike(_TURN) & ~F.contains(text, F.lit(CLOSE))
    own = lambda value: F.when(escaped, unescape(value)).otherwise(value)
    return F.when(fine, F.struct(own(role).alias("role"), own(text).alias("text")))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, mask): a row for each conversation, its turns in order.

    ``mask`` lists (turn, start, length) of the texts to learn, those of ``loss_role``: the place of the written turn
    among the turns, counted from 0, and where its text stands in it, in code points. Null roles and texts are empty
    ones. Turns go by number, null first, and equal numbers by role and text; repeated rows are turns of their own; rows
    without a conversation's id are one conversation with a null id. An empty table gives no rows; other columns are
    ignored. A conversation is one string, so it has to fit in one row of a task.
    """
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    source = F.struct("role", "text")
    # Most turns never conflict; each is tried by itself, where it is read.
    tried = parse(render(F.col("role"), F.col("text"), F.lit(False)))
    rows = rows.withColumn("escaped", ~F.coalesce(tried == F.array(source), F.lit(False)))
    order = F.struct(F.col("turn").isNotNull(), "turn", "role", "text", "escaped")
    whole = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["escaped"].alias("escaped"))).alias("turns"))
    written = lambda every: F.transform("turns", lambda t: render(t["role"], t["text"], t["escaped"] | F.lit(every)))
    same = lambda formatted: F.coalesce(parse(formatted) == F.transform("turns", lambda t: F.struct(t["role"], t["text"])), F.lit(False))
    tries = whole.withColumn("once", F.array_join(written(False), "")).withColumn("every", ~same(F.col("once")))
    final = F.when(~F.col("every"), F.col("once")).otherwise(F.array_join(written(True), ""))
    failed = F.raise_error(F.concat(F.lit("no round trip: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string")
    tries = tries.withColumn("formatted", final)
    tries = tries.withColumn("formatted", F.when(~F.col("every"), F.col("formatted")).otherwise(F.when(same(F.col("formatted")), F.col("formatted")).otherwise(failed)))

    def span(t: Column, i: Column) -> Column:
        escaped = t["escaped"] | F.col("every")
        own = lambda value, escapes: F.length(F.when(escaped, escape(value, escapes)).otherwise(value))
        header = F.lit(len(OPEN)) + own(t["role"], ROLE_ESCAPES) + F.when(escaped, 3).otherwise(2)
        return F.when(t["role"] == loss_role, F.struct(i.alias("turn"), header.alias("start"), own(t["text"], ESCAPES).alias("length")))

    return tries.select("conv_id", "formatted", F.filter(F.transform("turns", span), lambda s: s.isNotNull()).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): turns as parsed, and the texts under the mask one after another."""
    pieces = formatted.withColumn("pieces", turn_pieces(F.col("formatted")))

    def masked(m: Column) -> Column:
        piece = F.get("pieces", m["turn"])
        text = F.substring(piece, m["start"] + 1, m["length"])
        # The header ends with a blank, and of an escaped turn with a backslash before it.
        return F.when(F.substring(piece, m["start"] - 1, F.lit(2)) == "\\ ", unescape(text)).otherwise(text)

    return pieces.select("conv_id", F.transform("pieces", _read).alias("turns"), F.array_join(F.transform("mask", masked), "").alias("loss_text"), "formatted")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The turns with those of the conversation that looks like the template."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    turn = F.col("id")
    probe = rows.sparkSession.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return rows.unionByName(probe)


def op12_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations formatted, written, and read back."""
    turns = with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    back = read_back(materialise(format_conversations(turns), "chats"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(lines).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(value: str, escapes) -> str:
    for plain, written in escapes:
        value = f"replace({value}, '{plain}', '{written}')"
    return value


OP12_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, contains(role, ':') OR contains(role, '{OPEN}') OR contains(text, '{OPEN}') OR contains(role, '{CLOSE}') OR contains(text, '{CLOSE}') AS escaped FROM t),
w AS (SELECT *, '{OPEN}' || CASE WHEN escaped THEN {_escaped_sql("role", ROLE_ESCAPES)} || ':\\ ' || {_escaped_sql("text", ESCAPES)} ELSE role || ': ' || text END || '{CLOSE}' || chr(10) AS written FROM e),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
  coalesce(string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss, sum(length(written)) AS formatted_chars FROM w GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
