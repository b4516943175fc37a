"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What the machine allows and what it writes.

    ``moves`` names the roles that may follow each state; the state after a turn is its role. ``ends`` are the accepting
    states. ``marks`` are the control strings before and after a turn's text. A role without marks (null and empty ones
    too) is written into ``other``: before the role, between role and text, after the text. Texts of ``learned`` roles
    carry the loss.
    """

    start: str = "start"
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        controls = self.controls
        heads, rests = {c[0] for c in controls}, [c[1:] for c in controls]
        if len(set(controls)) != len(controls) or any(len(c) < 2 or "\\" in c for c in controls):
            raise ValueError("control strings must differ, have two characters or more and no backslash")
        for a in controls:
            if any(a != b and a in b or any(b.startswith(a[-n:]) for n in range(1, len(a))) for b in controls):
                raise ValueError(f"{a} overlaps with another control string")
            if any(a[i] in heads and any(r.startswith(a[i + 1 :]) or a[i + 1 :].startswith(r) for r in rests) for i in range(1, len(a))):
                raise ValueError(f"escaping would begin again within {a}")

    @property
    def controls(self) -> list[str]:
        return [*(m for pair in self.marks.values() for m in pair), *self.other]

    @property
    def escaped(self) -> str:
        """Pattern of a control string with any number of backslashes after its first character, as groups: character, rest."""
        heads = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rests = "|".join(sorted({re.escape(c[1:]) for c in self.controls}))
        return rf"([{heads}])(\\*(?:{rests}))"

    @property
    def ending(self) -> str:
        return "|".join(re.escape(m) for m in [*(pair[1] for pair in self.marks.values()), self.other[2]])


TEMPLATE = Template()

#: A conversation of control strings that is formatted besides the given ones, under this id.
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    """One more backslash after the first character of whatever is a control string but for backslashes there.

    As no control string begins within another, no replacement makes or breaks a second one, and ``unescape`` takes back exactly this.
    """
    return F.regexp_replace(text, template.escaped, r"$1\\$2")


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, template.escaped.replace(r"(\\*", r"\\(\\*", 1), "$1$2")


def with_probe(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``added``: the given rows and the conversation of control strings, which never joins a given one."""
    given = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("added"))
    rows = [(PROBE_ID, 0, "user", PROBE_TEXT, True), (PROBE_ID, 1, "assistant", PROBE_TEXT, True)]
    probe = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string, added boolean")
    return given.unionByName(probe)


def formatted(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row a conversation: conv_id, added, valid, complete, first_error and segments (text, loss).

    ``turns`` has conv_id, turn, role, text and added, as ``with_probe`` gives. Turns come by number, null ones last, ties by role
    and text; repeated rows are turns of their own; rows with a null conv_id are one conversation. The machine reads the
    roles in this order: ``valid`` says that every move is allowed, ``first_error`` is the position (from 0) of the first that is
    not, ``complete`` that the last state accepts. A conversation out of order is formatted all the same. A conversation is one
    training example, so its turns become one row; the groups themselves are never gathered otherwise. No rows give no result.
    """
    turn = F.struct(F.col("turn").isNull().alias("none"), "turn", "role", "text")
    conversations = turns.groupBy("conv_id", "added").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    moves = [(state, role) for state, roles in template.moves.items() for role in roles]

    def ok(t: Column, i: Column) -> Column:
        state = F.when(i == 0, F.lit(template.start)).otherwise(F.try_element_at("turns", i)["role"])
        return reduce(or_, [(state == s) & (t["role"] == r) for s, r in moves], F.lit(False))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def marked(t: Column) -> Column:
        before = F.concat(F.lit(template.other[0]), escape(t["role"], template), F.lit(template.other[1]))
        after = F.lit(template.other[2])
        for role, (first, last) in template.marks.items():
            before, after = F.when(t["role"] == role, F.lit(first)).otherwise(before), F.when(t["role"] == role, F.lit(last)).otherwise(after)
        return F.array(segment(before, F.lit(False)), segment(escape(t["text"], template), t["role"].isin(*template.learned)), segment(after, F.lit(False)))

    checked = conversations.withColumn("errors", F.transform("turns", lambda t, i: ~ok(t, i)))
    return checked.select(
        "conv_id",
        "added",
        (~F.array_contains("errors", True)).alias("valid"),
        F.element_at("turns", -1)["role"].isin(*template.ends).alias("complete"),
        F.when(F.array_contains("errors", True), F.array_position("errors", True) - 1).alias("first_error"),
        F.flatten(F.transform("turns", marked)).alias("segments"),
    )


def texts(segments: Column) -> Column:
    """The formatted text of a conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned_text(segments: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def turns_of(text: Column, template: Template = TEMPLATE) -> Column:
    """The turns (role, text) of a formatted text, read by its control strings alone."""
    pieces = F.split(text, template.ending, -1)

    def turn(p: Column) -> Column:
        first, middle = template.other[:2]
        role = unescape(F.substring_index(F.substr(p, F.lit(len(first) + 1)), middle, 1), template)
        body = F.substr(p, F.position(F.lit(middle), p) + len(middle))
        for name, (mark, _) in template.marks.items():
            here = F.startswith(p, F.lit(mark))
            role, body = F.when(here, F.lit(name)).otherwise(role), F.when(here, F.substr(p, F.lit(len(mark) + 1))).otherwise(body)
        return F.struct(role.alias("role"), unescape(body, template).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def digests(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, complete, first_error of every conversation and the probe.

    All of it is read back from the formatted output: the turns by its control strings, the learned text by its loss flags.
    """
    out = formatted(with_probe(conversations), template)
    read = out.withColumn("formatted", texts(F.col("segments"))).withColumn("learned", learned_text(F.col("segments"), template))
    read = read.withColumn("read", turns_of(F.col("formatted"), template))
    turns_text = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns_text, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "complete",
        "first_error",
    )
