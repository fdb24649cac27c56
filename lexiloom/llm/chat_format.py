"""Chat formatting, with DataFrame functions only.

A declarative template gives each role its opening and closing marker, says whether its text is under the loss, and
lists which role may follow which: a finite-state machine whose state is the last role. Each conversation becomes
segments (marker or text, with a loss flag) and their concatenation. Markers inside texts are escaped reversibly, so
the turns can be read back from the formatted string alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "^", "$"


@dataclass(frozen=True)
class Turn:
    role: str
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """turns: the known roles. other: wraps any other role, whose name is written between opens and divides. follows: the machine's moves."""

    turns: tuple[Turn, ...]
    other: Turn
    divides: str
    follows: dict[str, frozenset[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        marks = self.controls()
        for c in marks:
            if "\\" in c or len(c) < 2:
                raise ValueError(f"marker {c!r}: two characters at least and no backslash")
            for m in marks:
                if c != m and c in m:
                    raise ValueError(f"marker {c!r} lies in {m!r}")
                if any(m.startswith(c[k:]) or m.endswith(c[:k]) for k in range(1, len(c))):
                    raise ValueError(f"the end or start of marker {m!r} could complete {c!r} in a text")

    def controls(self) -> list[str]:
        return sorted({m for t in (*self.turns, self.other) for m in (t.opens, t.closes)} | {self.divides})


#: Production template: loss on assistant texts only; an optional system turn first, then user and assistant in turns.
CHAT = Template(
    turns=(
        Turn("system", "<<SYS>>", "<</SYS>>"),
        Turn("user", "[INST]", "[/INST]"),
        Turn("assistant", "<s>", "</s>", loss=True),
    ),
    other=Turn("", "[ROLE]", "[/ROLE]"),
    divides="[TEXT]",
    follows={
        START: frozenset({"system", "user"}),
        "system": frozenset({"user"}),
        "user": frozenset({"assistant"}),
        "assistant": frozenset({"user", END}),
    },
)


def _breakable(t: Template) -> str:
    return "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in t.controls())


def escape(text: Column, t: Template) -> Column:
    r"""Backslashes double, and \| parts the first character of every marker from its rest."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({_breakable(t)})", r"$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|\|)", "$1")


def _moves(t: Template, roles: Column) -> Column:
    """Index of the first turn that the machine refuses (the count of turns if it may not end there); null if it accepts."""
    ok = [F.concat(F.lit(a), F.lit("\n"), F.lit(b)) for a, to in t.follows.items() for b in sorted(to)]
    pairs = F.transform(
        F.arrays_zip(F.concat(F.array(F.lit(START)), roles).alias("a"), F.concat(roles, F.array(F.lit(END))).alias("b")),
        lambda p, i: F.when(F.concat(p["a"], F.lit("\n"), p["b"]).isin(*ok), F.lit(None)).otherwise(i),
    )
    return F.array_min(pairs)


def format_chats(turns: DataFrame, template: Template = CHAT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, n_turns, segments, formatted, valid, refused_at), a row per conversation.

    segments: array of (role, part, text, loss); text segments are escaped; formatted is their concatenation.
    valid is false where the machine refuses the turn order; refused_at is the turn (from 0) it stops at. Refused
    conversations are formatted too: dropping them is the caller's choice. Rows go by turn, then role, then text, nulls
    first; repeated rows stay. Null or empty texts are empty texts, a null role is the empty role, rows with a null
    conversation form one. Other columns are left out. An empty table gives an empty result.

    One shuffle by conversation of the four columns used. A conversation is one row of the output, so it has to fit
    a task as any single value does.
    """
    t = template
    clean = turns.select(
        F.col(conv_col).alias("_conv"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("_row"),
    )
    grouped = clean.groupBy("_conv").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))

    def segment(part: str, text: Column, loss: Column, role: Column) -> Column:
        return F.struct(role.alias("role"), F.lit(part).alias("part"), text.alias("text"), loss.alias("loss"))

    no = F.lit(False)

    def of(row: Column) -> Column:
        role, body = row["role"], escape(row["text"], t)
        out = F.array(
            segment("open", F.concat(F.lit(t.other.opens), escape(role, t), F.lit(t.divides)), no, role),
            segment("text", body, F.lit(t.other.loss), role),
            segment("close", F.lit(t.other.closes), no, role),
        )
        for x in t.turns:
            known = F.array(segment("open", F.lit(x.opens), no, role), segment("text", body, F.lit(x.loss), role), segment("close", F.lit(x.closes), no, role))
            out = F.when(role == x.role, known).otherwise(out)
        return out

    made = grouped.select(
        F.col("_conv").alias(conv_col),
        F.size("_rows").cast("long").alias("n_turns"),
        F.flatten(F.transform("_rows", of)).alias("segments"),
        _moves(t, F.col("_rows")["role"]).cast("long").alias("refused_at"),
    )
    return made.select(
        conv_col, "n_turns", "segments", F.array_join(F.col("segments")["text"], "").alias("formatted"), F.col("refused_at").isNull().alias("valid"), "refused_at"
    )


def parse_chat(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted string: array of (role, text), unescaped."""
    t = template
    known = "|".join(f"{re.escape(x.opens)}.*?{re.escape(x.closes)}" for x in (*t.turns, t.other))

    def read(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(t.other.opens) + 1), F.length(piece) - len(t.other.opens) - len(t.other.closes))
        at = F.instr(inner, t.divides)
        out = F.struct(unescape(F.substring(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substring(inner, at + len(t.divides), F.length(inner))).alias("text"))
        for x in t.turns:
            body = F.substring(piece, F.lit(len(x.opens) + 1), F.length(piece) - len(x.opens) - len(x.closes))
            out = F.when(piece.startswith(x.opens), F.struct(F.lit(x.role).alias("role"), unescape(body).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{known})"), F.lit(0)), read)


def digest_chats(made: DataFrame, template: Template = CHAT, conv_col: str = "conv_id") -> DataFrame:
    """Read back from the output: turns from the formatted string, trained text from the segments under the loss."""
    back = made.select(
        conv_col,
        parse_chat(F.col("formatted"), template).alias("_turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
    said = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        conv_col,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
