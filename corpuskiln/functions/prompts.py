"""Prompts for evaluation cases and chats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What asks for the third label (fixed value).
UNKNOWN_ASKED = r"\b(?:unknown|indeterminate|cannot\s+determine|insufficient\s+information)\b"


def label_options(question: Column) -> Column:
    """The labels a reply may end with; Unknown only where the question speaks of it."""
    both = F.array(F.lit("Entailment"), F.lit("Contradiction"))
    return F.when(F.lower(F.coalesce(question, F.lit(""))).rlike(UNKNOWN_ASKED), F.array_append(both, F.lit("Unknown"))).otherwise(both)


def system_prompt(context: Column) -> Column:
    """Instructions with the excerpts, or without where there are none."""
    plain = "You answer questions about tax law. Say so if you don't know."
    given = F.concat(F.lit("You answer questions about tax law from these excerpts and cite their section ids.\n\nExcerpts:\n\n"), context)
    return F.when(F.coalesce(context, F.lit("")) == "", F.lit(plain)).otherwise(given)


def case_prompt(question: Column, context: Column, facts: Column, expected_type: Column, allowed: Column) -> Column:
    """A case's text, facts, question, allowed citations and what the reply must end with."""
    options = F.array_join(label_options(question), ", ")
    ending = (
        F.when(expected_type == "numeric", F.lit("Show the steps of the calculation.\nEnd with: Final Answer: <number>."))
        .when(expected_type == "label", F.concat(F.lit("Final Answer must be exactly one of: "), options, F.lit(".")))
        .otherwise(F.lit("End with: Final Answer: <value or label>."))
    )
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Text:\n"), F.coalesce(F.nullif(context, F.lit("")), F.lit("(none)"))),
        F.concat(F.lit("Facts:\n"), F.coalesce(F.nullif(facts, F.lit("")), F.lit("(none)"))),
        F.concat(F.lit("Question:\n"), question),
        F.concat(F.lit("Citations allowed:\n"), F.when(F.size(allowed) > 0, F.array_join(allowed, ", ")).otherwise(F.lit("None"))),
        ending,
    )
