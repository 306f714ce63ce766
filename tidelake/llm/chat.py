"""Chat formatting: a role state machine, a declarative template and per-segment loss flags.

Everything is DataFrame expressions. A template names, for each role, the text before and after a turn and whether
the turn's text is trained on. Control strings inside texts are escaped reversibly: the escape sign first, then each
control sign, so that no control string of the template can arise from a text.

Defined results: null text counts as empty, null role as the role "unknown"; turns are ordered by (turn, role, text), so
ties and repeated rows have one order and each is a turn; conversations whose role order the machine refuses are formatted
too, with valid = false; an empty table gives an empty result. A null conversation id is a conversation of its own.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks and flags of a chat format. Each mark must hold one of the escaped signs."""

    before: str = "### {role}: "
    after: str = " </turn>\n"
    titles: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)
    #: sign -> its escape; the first is the escape sign itself
    escapes: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<", "&lt;"), ("#", "&num;"))
    #: state -> {role: next state}; the machine starts in "start" and may end in the states of `final`
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"},
        "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: tuple[str, ...] = ("answered", "asked")


def _case(value: Column, choices: dict[str, Column], default: Column) -> Column:
    out = None
    for k, v in choices.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(default) if out is not None else default


def escape(text: Column, template: ChatTemplate) -> Column:
    for sign, code in template.escapes:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column, template: ChatTemplate) -> Column:
    for sign, code in reversed(template.escapes):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def format_conversations(df: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments (array of text and loss), formatted (their join)."""
    t = template or ChatTemplate()
    role = F.coalesce(F.col(role_col), F.lit("unknown"))
    turns = df.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(
        F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))).alias("turns"))

    states = sorted({s for s in t.moves} | {x for m in t.moves.values() for x in m.values()})

    def move(state: Column, x: Column) -> Column:
        return _case(state, {s: _case(x["role"], {r: F.lit(to) for r, to in t.moves.get(s, {}).items()}, F.lit("refused")) for s in states}, F.lit("refused"))

    def segment(x: Column) -> Column:
        other = F.concat(F.lit("?"), F.replace(escape(x["role"], t), F.lit(":"), F.lit("&colon;")))
        title = _case(x["role"], {r: F.lit(name) for r, name in t.titles.items()}, other)
        left, right = t.before.split("{role}")
        loss = x["role"].isin(list(t.loss_roles)).cast("int")
        return F.array(
            F.struct(F.concat(F.lit(left), title, F.lit(right)).alias("text"), F.lit(0).alias("loss")),
            F.struct(escape(x["text"], t).alias("text"), loss.alias("loss")),
            F.struct(F.lit(t.after).alias("text"), F.lit(0).alias("loss")))

    machine = F.aggregate("turns", F.lit("start"), move)
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), machine.isin(list(t.final)).alias("valid"),
        F.flatten(F.transform("turns", segment)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The array of (role, text) that a formatted text holds."""
    t = template or ChatTemplate()
    left, right = t.before.split("{role}")
    parts = F.filter(F.split(formatted, f"\\Q{t.after}\\E"), lambda x: x != "")
    back = {name: role for role, name in t.titles.items()}

    def turn(x: Column) -> Column:
        head = F.substring_index(x, right, 1)
        title = F.substr(head, F.lit(len(left) + 1))
        other = unescape(F.replace(F.substr(title, F.lit(2)), F.lit("&colon;"), F.lit(":")), t)
        text = F.substr(x, F.length(head) + F.lit(len(right) + 1))
        return F.struct(_case(title, {n: F.lit(r) for n, r in back.items()}, other).alias("role"), unescape(text, t).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    t = template or ChatTemplate()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"] == 1), lambda s: unescape(s["text"], t)), "")
