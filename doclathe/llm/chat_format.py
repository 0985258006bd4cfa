"""Chat formatting: turns checked by a state machine over roles and written by a template."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table


@dataclass(frozen=True)
class Marks:
    """What stands before and after a turn's text, and whether the text is trained on."""

    before: str
    after: str
    loss: bool = False


#: Fixed strings of a widely used instruction format. A role not listed is written out.
TEMPLATE = {"system": Marks("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": Marks("[INST] ", " [/INST]"), "assistant": Marks("", "</s>", True)}
ROLE, OTHER = Marks("[ROLE]", "[/ROLE]"), Marks("", "[/TURN]")
#: State machine: the role before ('' at the start) and the roles that may follow.
ORDER = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def _controls(template: dict[str, Marks]) -> list[tuple[str, str]]:
    """Control strings, each parted after its opening brackets."""
    marks = [m for x in (*template.values(), ROLE, OTHER) for m in (x.before.strip(), x.after.strip()) if m]
    return sorted({re.fullmatch(r"([<\[]+)(.+)", m, re.S).groups() for m in [*marks, "<s>"]})


def escape_pattern(template: dict[str, Marks]) -> str:
    return "|".join(f"{re.escape(a)}(?={re.escape(b)})" for a, b in _controls(template))


def escaped(text: Column, template: dict[str, Marks]) -> Column:
    """The text with each backslash doubled and one put into each control string, after its brackets."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), escape_pattern(template), r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _pick(role: Column, template: dict[str, Marks], what, other: Column) -> Column:
    return reduce(lambda rest, kv: F.when(role == kv[0], F.lit(what(kv[1]))).otherwise(rest), template.items(), other)


def conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one row for each conv_id with its turns in order.

    Null roles and texts are empty; turns of equal number are ordered by role and text, and
    repeated rows are separate turns; null turns come first. A null conv_id is a conversation.
    One conversation is one row of the result, so it must fit a task.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def format_chats(rows: DataFrame, template: dict[str, Marks] = TEMPLATE, order: dict[str, tuple[str, ...]] = ORDER) -> DataFrame:
    """Each conversation's segments (text, loss), their concatenation, and its verdict.

    valid_order: every turn may follow the one before; complete: and the last is trained on.
    Conversations out of order are formatted all the same, so that the caller decides. No rows
    give none; nulls, ties and repeated rows are as `conversations` says; other columns don't matter.
    Returns conv_id, segments, formatted, valid_order, complete.
    """
    step = F.create_map(*[F.lit(x) for a, after in order.items() for b in after for x in (f"{a}>{b}", b)])
    last = F.aggregate("turns", F.lit(""), lambda state, t: F.coalesce(F.try_element_at(step, F.concat(state, F.lit(">"), t["role"])), F.lit("!")))

    def segments(t: Column) -> Column:
        role, plain = t["role"], F.lit(False)
        named = F.concat(F.lit(ROLE.before), escaped(role, template), F.lit(ROLE.after + OTHER.before))
        return F.array(
            F.struct(_pick(role, template, lambda m: m.before, named).alias("text"), plain.alias("loss")),
            F.struct(escaped(t["text"], template).alias("text"), _pick(role, template, lambda m: m.loss, F.lit(OTHER.loss)).alias("loss")),
            F.struct(_pick(role, template, lambda m: m.after, F.lit(OTHER.after)).alias("text"), plain.alias("loss")),
        )

    trained = [r for r, m in template.items() if m.loss]
    out = conversations(rows).select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), last.alias("_last"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), (F.col("_last") != "!").alias("valid_order"), F.col("_last").isin(trained).alias("complete"))


def parse_chat(formatted: Column, template: dict[str, Marks] = TEMPLATE) -> Column:
    """The turns (role, text) that a formatted string was made of."""
    ways = sorted(template.items(), key=lambda kv: not kv[1].before)
    other = f"{re.escape(ROLE.before)}(?:.*?){re.escape(ROLE.after + OTHER.before)}(?:.*?){re.escape(OTHER.after)}"
    marked = [f"{re.escape(m.before)}(?:.*?){re.escape(m.after)}" for _, m in ways]
    bare = sum(not m.before for m in template.values())
    pattern = "(?s)" + "|".join([*marked[: len(marked) - bare], other, *marked[len(marked) - bare :]])

    def turn(x: Column) -> Column:
        body = lambda before, after: F.substring(x, F.lit(len(before) + 1), F.length(x) - len(before) - len(after))
        got = F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
        for role, m in reversed(ways):
            if not m.before:
                got = F.struct(F.lit(role).alias("role"), unescaped(body("", m.after)).alias("text"))
        named = F.struct(
            unescaped(F.regexp_extract(x, f"(?s)^{re.escape(ROLE.before)}(.*?){re.escape(ROLE.after)}", 1)).alias("role"),
            unescaped(F.regexp_extract(x, f"(?s)^{re.escape(ROLE.before)}.*?{re.escape(ROLE.after + OTHER.before)}(.*){re.escape(OTHER.after)}$", 1)).alias("text"),
        )
        got = F.when(x.startswith(ROLE.before), named).otherwise(got)
        for role, m in ways:
            if m.before:
                got = F.when(x.startswith(m.before), F.struct(F.lit(role).alias("role"), unescaped(body(m.before, m.after)).alias("text"))).otherwise(got)
        return got

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), turn)


def op5_role_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -1, formatted and read back."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), (F.col("id") + 1).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_chats(rows).select("*", parse_chat(F.col("formatted")).alias("turns"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), loss.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid_order")
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars", "valid_order")


def _re2(pattern: str) -> str:
    return pattern.replace("\\/", "/").replace("'", "''")


QUERIES = {"op5_role_machine": op5_role_machine}
_ESCAPES = "|".join(sorted({f"{re.escape(b)}" for _, b in _controls(TEMPLATE)}))
ORACLES = {
    "op5_role_machine": f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 1, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 2, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (SELECT *, row_number() OVER w AS k, lag(role, 1, '') OVER w AS previous,
  length(regexp_replace(replace(text, '\\', '\\\\'), '(<<|<|\\[)({_re2(_ESCAPES)})', '\\1_\\2', 'g')) AS chars,
  length(regexp_replace(replace(role, '\\', '\\\\'), '(<<|<|\\[)({_re2(_ESCAPES)})', '\\1_\\2', 'g')) AS role_chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
said AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum(chars + CASE role {' '.join(f"WHEN '{r}' THEN {len(m.before) + len(m.after)}" for r, m in TEMPLATE.items())}
    ELSE role_chars + {len(ROLE.before + ROLE.after + OTHER.before + OTHER.after)} END) AS BIGINT) AS formatted_chars,
  bool_and(previous || '>' || role IN ({', '.join(f"'{a}>{b}'" for a, after in ORDER.items() for b in after)})) AS valid_order
  FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, valid_order FROM said"""
}
