"""Patterns, normal forms and message functions over text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RoleBoundaryConfig

# The patterns that tell a plan that oversteps its role.
FENCE = "```"
OVERREACH_BASIC = (
    r"(?i)```",
    r"(?i)\bdef\s+[A-Za-z_]\w*\s*\(",
    r"(?i)\bassert\s+",
    r"(?i)\b(?:here(?:'s| is)?|below is)\s+(?:the\s+)?(?:implementation|code|function)\b",
)
OVERREACH_EXTENDED = (
    r"(?i)```",
    r"(?i)\bdef\s+[A-Za-z_]\w*\s*\(",
    r"(?i)\bassert\s+",
    r"(?i)\btest\s+cases?\b",
    r"(?i)\bpython\s+code\s*:",
    r"(?i)\bpython\s+function\b",
    r"(?i)\b(?:here(?:'s| is)?|below is)\s+(?:the\s+)?(?:corrected\s+|final\s+)?(?:implementation|code|function)\b",
    r"(?i)\b(?:revised|corrected|final)\s+code\s*:",
    r"(?im)^\s*(?:implementation|code)\s*:",
)
BOUNDARY_DEF = r"(?m)^\s*def\s+\w+\s*\("
BOUNDARY_ASSERT = r"\bassert\b"
BOUNDARY_SCAFFOLD = ("test case", "if __name__", "print(", "all tests passed")
BOUNDARY_INTENT = r"\b(?:revised|corrected|final)\s+code\b|here(?:'s| is)\s+the\s+code|below is\s+the\s+code|python function"
EFFORT = (r"(?i)Estimated\s+effort\s+tokens\s*:\s*(\d+)", r"(?i)estimated\s+.*?tokens\s*[:=]\s*(\d+)")
EFFORT_LINE = r"(?i)^\s*estimated\s+effort\s+tokens\s*:\s*\d+\s*"
TASK_ID = r"Task ID:\s*(\S+)"
ROLES = {"system": "system", "human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant"}


def any_match(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [F.regexp_like(F.coalesce(text, F.lit("")), F.lit(p)) for p in patterns])


def overreach_basic(text: Column) -> Column:
    return any_match(text, OVERREACH_BASIC)


def overreach_extended(text: Column) -> Column:
    return any_match(text, OVERREACH_EXTENDED)


def strip(text: Column) -> Column:
    """Without white space (Unicode's too) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def normalize(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), r"(?U)\s+", " ")


def normalize_for_dedup(text: Column) -> Column:
    return normalize(F.regexp_replace(F.coalesce(text, F.lit("")), EFFORT_LINE, ""))


def text_hash(text: Column) -> Column:
    return F.sha1(normalize_for_dedup(text).cast("binary"))


def effort_tokens(plan: Column) -> Column:
    """The number that a plan states as its effort, by the first pattern that fits; else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(plan, p, 1), F.lit("")).try_cast("bigint") for p in EFFORT))


def role_boundary(plan: Column, cfg: RoleBoundaryConfig = RoleBoundaryConfig()) -> Column:
    """struct of five flags, their number and the penalty for them."""
    text = F.coalesce(plan, F.lit(""))
    low = F.lower(text)
    flags = {
        "code_block": F.contains(text, F.lit(FENCE)),
        "function_def": F.regexp_like(text, F.lit(BOUNDARY_DEF)),
        "assertion": F.regexp_like(text, F.lit(BOUNDARY_ASSERT)),
        "test_scaffold": reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in BOUNDARY_SCAFFOLD]),
        "code_intent": F.regexp_like(low, F.lit(BOUNDARY_INTENT)),
    }
    if not cfg.enabled:
        flags = dict.fromkeys(flags, F.lit(False))
    penalty = sum((F.when(on, getattr(cfg, name)).otherwise(0.0) for name, on in flags.items()), F.lit(0.0))
    number = sum((on.cast("int") for on in flags.values()), F.lit(0))
    return F.struct(*(on.alias(name) for name, on in flags.items()), number.alias("num_violations"), F.least(F.lit(cfg.most), penalty).alias("penalty"))


def task_id_of(stated: Column, human: Column) -> Column:
    """The id that the metadata state, else the one named in the first human message, else unknown."""
    return F.coalesce(F.nullif(stated, F.lit("")), F.nullif(F.regexp_extract(human, TASK_ID, 1), F.lit("")), F.lit("unknown"))


def strip_code_fence(text: Column) -> Column:
    """What the first fence of three backticks holds, else the whole text; white space cut off."""
    fenced = rf"(?is){FENCE}(?:python)?\s*(.*?){FENCE}"
    return F.when(F.regexp_like(text, F.lit(fenced)), strip(F.regexp_extract(text, fenced, 1))).otherwise(strip(text))


def import_prelude(prompt: Column) -> Column:
    """The import lines of a prompt in front of its first function."""
    lines = F.split(prompt, "\r\n|\n|\r")
    is_def = F.transform(lines, lambda x: strip(x).startswith("def "))
    first = F.array_position(is_def, True)
    head = F.when(first > 0, F.slice(lines, 1, (first - 1).cast("int"))).otherwise(lines)
    return strip(F.array_join(F.filter(head, lambda x: strip(x).startswith("import ") | strip(x).startswith("from ")), "\n"))


def extract_code(generated: Column, entry_point: Column, prompt: Column) -> Column:
    """struct<code, code_type>: from the asked function on, else from any function on, else the text as a completion."""
    text = strip_code_fence(generated)
    asked = F.instr(text, F.concat(F.lit("def "), entry_point))
    any_def = F.regexp_instr(text, F.lit(r"(^|\n)def\s+\w+\s*\("))
    start = F.when(asked > 0, asked).when(any_def > 0, any_def)
    code = F.concat(strip(F.substr(text, start)), F.lit("\n"))
    prelude = import_prelude(prompt)
    needs = (prelude != "") & ~F.contains(F.substr(code, F.lit(1), F.lit(500)), prelude)
    full = F.when(needs, F.concat(prelude, F.lit("\n\n"), code)).otherwise(code)
    return F.struct(F.when(start.isNotNull(), full).otherwise(F.concat(rstrip(text), F.lit("\n"))).alias("code"), F.when(start.isNotNull(), "full_code").otherwise("completion").alias("code_type"))


def role_of(said: Column, role: Column) -> Column:
    """Chat role of a message: by its sender, else its stated role, else user."""
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.coalesce(said, F.lit("user"))), role, F.lit("user"))


def merge_system(messages: Column) -> Column:
    """array<struct<role, content>> with the system texts in front of the first user message (or as one)."""
    system = strip(F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n"))
    rest = F.filter(messages, lambda m: m["role"] != "system")
    first_is_user = F.coalesce(F.get(rest, F.lit(0))["role"] == "user", F.lit(False))
    joined = F.transform(rest, lambda m, i: F.when(i == 0, F.struct(m["role"].alias("role"), F.concat(system, F.lit("\n\n"), m["content"]).alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    alone = F.concat(F.array(F.struct(F.lit("user").alias("role"), system.alias("content"))), F.transform(rest, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    return F.when(system == "", F.transform(rest, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).when(first_is_user, joined).otherwise(alone)


def sharegpt(system: str, human: Column, chosen: Column, rejected: Column, metadata: Column, weight: Column) -> list[Column]:
    """The columns of a training row: conversations, chosen, rejected, metadata, weight."""

    def said(who: str, value: Column) -> Column:
        return F.struct(F.lit(who).alias("from"), value.alias("value"))

    return [
        F.array(said("system", F.lit(system)), said("human", human)).alias("conversations"),
        said("gpt", F.concat(strip(F.coalesce(chosen, F.lit(""))), F.lit("\n"))).alias("chosen"),
        said("gpt", F.concat(strip(F.coalesce(rejected, F.lit(""))), F.lit("\n"))).alias("rejected"),
        metadata.alias("metadata"),
        weight.cast("double").alias("weight"),
    ]


def sequence_plan(prompt: Column, response: Column, max_length: int, eos: int) -> Column:
    """struct<prompt, response> of token arrays cut to max_length: the response ends with eos, the prompt keeps its end."""
    ended = F.when(F.coalesce(F.try_element_at(response, F.lit(-1)) == eos, F.lit(False)), response).otherwise(F.concat(response, F.array(F.lit(eos))))
    cut = F.when(F.size(ended) >= max_length, F.concat(F.slice(ended, 1, max_length - 1), F.array(F.lit(eos)))).otherwise(ended)
    room = F.greatest(F.lit(1), F.lit(max_length) - F.size(cut))
    kept = F.when(F.size(prompt) > room, F.slice(prompt, F.size(prompt) - room + 1, room)).otherwise(prompt)
    return F.struct(kept.alias("prompt"), cut.alias("response"))


def padded(tokens: Column, length: Column, pad: int) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(tokens))))
