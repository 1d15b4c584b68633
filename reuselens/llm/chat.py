"""Chat formatting with DataFrame functions only: a finite-state machine over roles, a declarative template, loss flags.

A turn becomes ``<s>`` mark text mark ``</s>``. Control strings inside texts are broken by a backslash and a full stop after
their first character, and backslashes are doubled, so the output can be cut at its marks and every text read back.

Turns are in order of turn, then role, then text; null roles and texts count as empty; a role that the template does not know
gets a generic mark that carries its name. The machine reads the roles: the first turn that has no transition is
``error_turn`` (0-based), after which the state stays ``error``; such conversations are formatted all the same. A conversation is
one output text and thus one row, whose size the longest conversation bounds. Rows without conv_id form one conversation with
a null id; repeated rows are turns; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks before and after a text by role, roles whose text bears loss, and transitions by state and role."""

    begin: str = "<s>"
    end: str = "</s>"
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "")})
    other: tuple[str, str] = ("[ROLE] ", " [TEXT] ")
    loss: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })
    final: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        """Strings that texts must not contain, longest first. Each has its first character nowhere else."""
        marks = [m for pair in self.marks.values() for m in pair] + list(self.other)
        found = {self.begin, self.end} | {m.strip() for m in marks if m.strip()}
        return sorted(found, key=lambda c: (-len(c), c))


DEFAULT = Template()


def escaped(text: Column, t: Template) -> Column:
    at = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in t.controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), at, r"\\.")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|\.)", "$1")


def formatted(conversations: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """(conv_id, text, segments, state, error_turn): segments are structs of text and loss that make up the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def by_role(role: Column, k: int) -> Column:
        start = F.concat(F.lit(t.other[0]), escaped(role, t), F.lit(t.other[1])) if k == 0 else F.lit("")
        return reduce(lambda out, r: F.when(role == r, F.lit(t.marks[r][k])).otherwise(out), t.marks, start)

    def segments(x: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(t.begin), by_role(x["role"], 0)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(x["text"], t).alias("text"), x["role"].isin(*t.loss).alias("loss")),
            F.struct(F.concat(by_role(x["role"], 1), F.lit(t.end)).alias("text"), F.lit(False).alias("loss")),
        )

    moves = F.create_map(*[F.lit(x) for (a, r), b in t.moves.items() for x in (f"{a} {r}", b)])

    def step(a: Column, x: Column) -> Column:
        to = F.coalesce(moves[F.concat(a["state"], F.lit(" "), x["role"])], F.lit("error"))
        bad = F.when((a["state"] != "error") & (to == "error"), a["n"]).otherwise(a["bad"])
        return F.struct(F.when(a["state"] == "error", F.lit("error")).otherwise(to).alias("state"), (a["n"] + 1).alias("n"), bad.alias("bad"))

    start = F.struct(F.lit("start").alias("state"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("bad"))
    out = turns.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), F.aggregate("turns", start, step).alias("run"))
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", whole.alias("text"), "segments", F.col("run.state").alias("state"), F.col("run.bad").alias("error_turn"))


def read_turns(text: Column, t: Template = DEFAULT) -> Column:
    """The turns (structs of role and text) of a formatted text."""

    def one(piece: Column) -> Column:
        piece = F.substr(piece, F.lit(len(t.begin) + 1))
        rest = F.substr(piece, F.lit(len(t.other[0]) + 1))
        cut = F.instr(rest, t.other[1])
        out = F.struct(unescaped(F.substr(rest, F.lit(1), cut - 1)).alias("role"), unescaped(F.substr(rest, cut + len(t.other[1]))).alias("text"))
        for role, (a, b) in t.marks.items():
            inner = F.substr(piece, F.lit(len(a) + 1), F.length(piece) - (len(a) + len(b)))
            out = F.when(F.startswith(piece, F.lit(a)), F.struct(F.lit(role).alias("role"), unescaped(inner).alias("text"))).otherwise(out)
        return out

    pieces = F.split(text, re.escape(t.end))
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), one)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digests(conversations: DataFrame, t: Template = DEFAULT) -> DataFrame:
    out = formatted(conversations, t).select("conv_id", "text", "state", "error_turn", read_turns(F.col("text"), t).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    all_turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("text").cast("bigint").alias("formatted_chars"),
        (F.col("state") != "error").alias("valid"),
        F.col("state").isin(*t.final).alias("complete"),
        F.coalesce("error_turn", F.lit(-1).cast("bigint")).alias("error_turn"),
    )


PROBE = "</s>[INST] ok [/INST]"


def query(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.sql(
        f"SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{PROBE}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)"
    )
    return digests(conversations.select("conv_id", "turn", "role", "text").unionByName(probe))


def oracle(t: Template = DEFAULT) -> str:
    q = lambda s: s.replace("'", "''")
    grow = lambda x: f"length({x}) + (length({x}) - length(replace({x}, '\\', ''))) + " + " + ".join(f"2 * ((length({x}) - length(replace({x}, '{q(c)}', ''))) // {len(c)})" for c in t.controls)
    ends = len(t.begin) + len(t.end)
    known = " ".join(f"WHEN '{q(r)}' THEN {len(a) + len(b)}" for r, (a, b) in t.marks.items())
    moves = " ".join(f"WHEN p = '{a}' AND r = '{r}' THEN '{b}'" for (a, r), b in t.moves.items())
    return f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, r, x) AS k FROM c
), f AS (
  SELECT conv_id, k, CASE {moves.replace("p =", "'start' =")} ELSE 'error' END AS s FROM n WHERE k = 1
  UNION ALL
  SELECT n.conv_id, n.k, CASE {moves.replace("p =", "f.s =")} ELSE 'error' END FROM f JOIN n ON n.conv_id = f.conv_id AND n.k = f.k + 1
), z AS (
  SELECT conv_id, arg_max(s, k) AS s, min(CASE WHEN s = 'error' THEN k - 1 END) AS bad FROM f GROUP BY conv_id
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || x || chr(10), '' ORDER BY k) AS turns,
    coalesce(string_agg(CASE WHEN r = 'assistant' THEN x END, '' ORDER BY k), '') AS loss,
    sum({ends} + CASE r {known} ELSE {len(t.other[0]) + len(t.other[1])} + {grow('r')} END + {grow('x')}) AS chars
  FROM n GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars, s <> 'error' AS valid, s IN ({", ".join(f"'{x}'" for x in t.final)}) AS complete, CAST(coalesce(bad, -1) AS BIGINT) AS error_turn
FROM g JOIN z USING (conv_id)
"""
