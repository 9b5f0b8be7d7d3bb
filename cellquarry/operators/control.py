"""Prompts, budgets and fingerprints around a program generator (no model is called)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_ANSWER_TOKENS, BASE_TOKENS, TOKENS_PER_MEMBER, MARGIN = 1536, 512, 150, 64
# Worked examples by target (ours).
EXAMPLES = {
    "YEAR": '{"kind":"arg_extremum","mode":"argmax","keys":[...],"values":[{"kind":"literal","value":2021,"dimension":"YEAR"},...]}',
    "PERCENT": '{"kind":"binary","operator":"*","left":{"kind":"binary","operator":"/",...},"right":{"kind":"literal","value":100,"dimension":"DIMENSIONLESS"}}',
    "RATIO": '{"kind":"binary","operator":"/","left":...,"right":...}',
}


def answer_tokens(cohort: Column) -> Column:
    return F.greatest(F.lit(LEAST_ANSWER_TOKENS), F.lit(BASE_TOKENS) + F.lit(TOKENS_PER_MEMBER) * cohort)


def output_room(limit: int, prompt: Column) -> Column:
    return F.lit(limit) - prompt - F.lit(MARGIN)


def program_prompt(question: Column, unit: Column, tickers: Column, years: Column, schemas: Column) -> Column:
    """The request for a program: what is asked, what must be read, and the tables without values."""
    examples = F.create_map(*[F.lit(x) for kv in EXAMPLES.items() for x in kv])
    shown = F.when(F.try_element_at(examples, unit).isNotNull(), F.concat(F.lit("Example: "), F.try_element_at(examples, unit)))
    return F.concat_ws(
        "\n", F.concat(F.lit("Question: "), question), F.concat(F.lit("Answer unit: "), unit), F.concat(F.lit("Read every ticker of: "), F.concat_ws(", ", tickers)),
        F.concat(F.lit("Read every year of: "), F.concat_ws(", ", F.transform(years, lambda y: y.cast("string")))), F.concat(F.lit("Cohort size: "), (F.size(tickers) * F.size(years)).cast("string")), shown, F.concat_ws("\n", schemas),
    )


def refusal_class(message: Column) -> Column:
    """The class of a soft refusal by its code."""
    return F.when(message.isin("MISSING_TICKERS", "MISSING_YEARS", "NO_UNIT_LINEAGE", "RANK_MISMATCH"), message).otherwise("HARD")


def run_fingerprint(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)
