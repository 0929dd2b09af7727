"""Prompt construction as native array/struct expressions.

Templates are parameters; the defaults below are our own short texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import col_

MESSAGE_TYPE = "array<struct<role: string, content: string>>"

# Our own default templates (content, not format: callers pass their own).
PERSONA_SYSTEM = ("Read the passage and describe up to three people who would care about it. "
                  'Answer in JSON: {"persona_list": [{"countries": [], "languages": [], "persona": ""}]}.')
EXPAND_SYSTEM = ("Given this persona as JSON, describe related people they work or live with. "
                 'Answer in JSON: {"persona_list": [{"countries": [], "languages": [], "persona": ""}]}.')
TASK_SYSTEM = ("Write new user requests in {seed_language} in the spirit of this example: {seed_prompt}. "
               'Answer in JSON: {"prompts": [{"prompt": "", "language": ""}]}.')
MATH_SYSTEM = ("Write new word problems in {seed_language} like this example: {seed_prompt}. "
               'Answer in JSON: {"prompts": [{"prompt": "", "language": ""}]}.')

# Labelled user-prompt layout (continuation lines carry four spaces).
LABEL_SEP = "\n    "


def message(role: str, content) -> Column:
    """One chat message struct."""
    return F.struct(F.lit(role).alias("role"), col_(content).cast("string").alias("content"))


def two_role(system, user) -> Column:
    """P5: [system, user]."""
    return F.array(message("system", system), message("user", user))


def two_role_cached(system, user) -> Column:
    """P5 with the provider cache hint on the system message (nullable struct)."""
    hint = F.struct(F.lit("ephemeral").alias("type"))
    none = F.lit(None).cast("struct<type: string>")
    sys_m = F.struct(F.lit("system").alias("role"), col_(system).alias("content"), hint.alias("cache_control"))
    usr_m = F.struct(F.lit("user").alias("role"), col_(user).alias("content"), none.alias("cache_control"))
    return F.array(sys_m, usr_m)


def one_role(system, user) -> Column:
    """System text + blank line + user text in one user message."""
    return F.array(message("user", F.concat(col_(system), F.lit("\n\n"), col_(user))))


def routed(model, one_role_models: list[str], system, user) -> Column:
    """Prompt shape chosen by model name."""
    return F.when(col_(model).isin(one_role_models), one_role(system, user)).otherwise(two_role(system, user))


def fill_template(template, seed_language, seed_prompt) -> Column:
    """Literal replacement, ``{seed_language}`` first, then ``{seed_prompt}``."""
    t = template if isinstance(template, Column) else F.lit(template)
    step1 = F.replace(t, F.lit("{seed_language}"), col_(seed_language))
    return F.replace(step1, F.lit("{seed_prompt}"), col_(seed_prompt))


def labelled_user_prompt(persona, language, subdomain=None, style=None, math: bool = False) -> Column:
    """P8: 'Persona: ..' then Domain/Style/Language lines (math: Language only)."""
    parts = [F.concat(F.lit("Persona: "), col_(persona))]
    if not math:
        parts += [F.concat(F.lit("Domain: "), col_(subdomain)), F.concat(F.lit("Style: "), col_(style))]
    parts.append(F.concat(F.lit("Language: "), col_(language)))
    return F.concat_ws(LABEL_SEP, *parts)


def persona_json(persona) -> Column:
    """JSON text of a persona struct (nulls kept; compared as JSON values)."""
    return F.to_json(col_(persona), {"ignoreNullFields": "false"})
