"""Chat formatting with DataFrame functions only: a finite-state machine over roles and a
declarative template with loss flags.

A turn becomes three segments: header, text, end. Texts are escaped so that no control
string can be read inside them: a backslash goes before every backslash and between the
two characters of the opening mark ``<|``. Undoing it is one replacement, so the output can be read back exactly.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``header`` has a place for the role; ``loss`` names the roles whose texts are trained on.

    ``moves``: state -> role -> next state; a role without a move leads to ``stuck`` for good.
    ``final``: states in which a conversation may end.
    """
    opening: str = "<|turn|>"
    closing: str = "<|end|>\n"
    loss: tuple = ("assistant",)
    start: str = "start"
    stuck: str = "stuck"
    final: tuple = ("answered",)
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })


CHAT = Template()
MARK, ESCAPED = "<|", "<\\|"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(MARK), F.lit(ESCAPED))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """As texts, and newlines too, since the header ends at one."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # "\n" written out stands for a newline unless its backslash is itself escaped.
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def end_state(roles: Column, template: Template) -> Column:
    """Struct of the state after all turns and the first turn (from 0) that had no move, or null."""
    table = F.create_map(*[F.lit(x) for s, by in template.moves.items() for r, t in by.items() for x in (f"{s}\n{r}", t)])
    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("turn"), F.lit(None).cast("int").alias("bad"))

    def step(acc, role):
        to = F.coalesce(F.try_element_at(table, F.concat(acc["state"], F.lit("\n"), role)), F.lit(template.stuck))
        bad = F.when(acc["bad"].isNull() & (to == template.stuck), acc["turn"]).otherwise(acc["bad"])
        return F.struct(to.alias("state"), (acc["turn"] + 1).alias("turn"), bad.alias("bad"))

    return F.aggregate(roles, first, step)


def format_conversations(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text; other columns are not read).

    segments: array of (text, loss) whose texts, joined, are ``formatted``; n_turns;
    valid: the turn order follows the machine and ends in a final state; bad_turn: the first turn without a move.
    Invalid conversations are formatted all the same. Null texts and roles count as empty.
    Turns that share a number are ordered by role, then text; a null number comes first;
    a null conv_id is a conversation like any other; an empty table gives no rows. A conversation is one sequence and so one row: its
    turns meet in one task, whose size the longest conversation sets.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t):
        return F.array(
            F.struct(F.concat(F.lit(template.opening), escape_role(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss).alias("loss")),
            F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")))

    out = grouped.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        end_state(F.transform("turns", lambda t: t["role"]), template).alias("end"))
    return out.select(
        "conv_id", "n_turns", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("end.state").isin(*template.final).alias("valid"), F.col("end.bad").cast("long").alias("bad_turn"))


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """Array of (role, text): the turns that ``formatted`` was made from."""
    turns = F.split(formatted, _quoted(template.closing))
    turns = F.slice(turns, 1, F.size(turns) - 1)  # nothing follows the last closing mark
    body = F.transform(turns, lambda t: F.substring(t, len(template.opening) + 1, 1 << 30))

    def parts(t):
        cut = F.instr(t, "\n")
        return F.struct(unescape_role(F.substring(t, 1, cut - 1)).alias("role"),
                        unescape(F.substring(t, cut + 1, 1 << 30)).alias("text"))

    return F.transform(body, parts)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")


def loss_of(turns: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask of turns that were read back, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"].isin(*template.loss)), lambda t: t["text"]), "")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
