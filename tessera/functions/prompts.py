"""Prompt text as column expressions (training and evaluation wordings differ)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import fixed


def _fill(template: str, **cols: Column) -> Column:
    """Concatenate ``template`` with ``{name}`` slots replaced by columns."""
    pieces = re.split(r"(\{[a-z_]+\})", template)
    out = []
    for p in pieces:
        if p.startswith("{") and p.endswith("}"):
            out.append(F.coalesce(cols[p[1:-1]], F.lit("")))
        elif p:
            out.append(F.lit(p))
    return F.concat(*out)


def train_prompt(question: Column, schema: Column) -> Column:
    """Training input text: instruction, schema, question, SQL marker (O-PR-1)."""
    return _fill(fixed.TRAIN_PROMPT, schema=schema, question=question)


def eval_prompt(question: Column, schema: Column) -> Column:
    """Evaluation prompt; the no-schema wording when the schema is empty (O-PR-2)."""
    return F.when(F.coalesce(F.length(schema), F.lit(0)) > 0,
                  _fill(fixed.EVAL_PROMPT, schema=schema, question=question)) \
        .otherwise(_fill(fixed.EVAL_PROMPT_NO_SCHEMA, question=question))


def eval_prompt_len(question: Column, schema: Column) -> Column:
    """Length of the evaluation prompt without building it (null text is empty)."""
    with_schema = len(fixed.EVAL_PROMPT) - len("{schema}") - len("{question}")
    no_schema = len(fixed.EVAL_PROMPT_NO_SCHEMA) - len("{question}")
    n_schema, n_question = F.coalesce(F.length(schema), F.lit(0)), F.coalesce(F.length(question), F.lit(0))
    return F.when(n_schema > 0, F.lit(with_schema) + n_schema + n_question).otherwise(F.lit(no_schema) + n_question)


def variants_array() -> Column:
    """The model variants, in report order."""
    return F.array(*[F.lit(v) for v, _ in fixed.VARIANTS])


def response_part(text: Column, marker: str = fixed.RESPONSE_TEMPLATE) -> Column:
    """Supervised part: the text after the first response marker, '' without one (O-PR-9)."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substring(text, at + len(marker), 1 << 30)).otherwise(F.lit(""))


def stop_truncate(answer: Column, stops: list[str] = fixed.STOP_SEQUENCES) -> Column:
    """Cut a generated answer at the first stop marker (O-PR-10)."""
    alt = "|".join(re.escape(s) for s in stops)
    return F.regexp_replace(answer, "(?s)(" + alt + ").*", "")
