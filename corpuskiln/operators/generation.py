"""Replies to prompts and judgements of replies through pluggable functions, with errors kept per case."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions.rouge import rouge
from corpuskiln.functions.text import judge_reply, rubric_reference

Generate = Callable[[str, str], str]


def dry_run(system: str, user: str) -> str:
    """Stands in for a model; never called over a network."""
    return f"[dry run] {len(system)} + {len(user)} characters"


def with_retries(generate: Generate, tries: int = 3, pause: float = 0.0, on: type[Exception] = TimeoutError) -> Generate:
    """Try again after errors of one kind, with a fixed pause."""

    def call(system: str, user: str) -> str:
        for left in range(tries - 1, -1, -1):
            try:
                return generate(system, user)
            except on:
                if not left:
                    raise
                time.sleep(pause)
        raise AssertionError

    return call


def replies(cases: DataFrame, generate: Generate = dry_run, system: str = "system", user: str = "user") -> DataFrame:
    """Adds response and error (null unless the call failed)."""
    schema = ", ".join(f"`{n}` {t}" for n, t in cases.dtypes) + ", response string, error string"

    def work(frames):
        for f in frames:
            said, failed = [], []
            for s, u in zip(f[system], f[user]):
                try:
                    said.append(generate(s or "", u or ""))
                    failed.append(None)
                except Exception as e:  # noqa: BLE001
                    said.append(None)
                    failed.append(f"{type(e).__name__}: {e}")
            yield f.assign(response=pd.Series(said, index=f.index, dtype=object), error=pd.Series(failed, index=f.index, dtype=object))

    return cases.mapInPandas(work, schema)


def judged(cases: DataFrame, judge: Generate, absent: float | None = None) -> DataFrame:
    """Adds earned, total, feedback and judge_failed to cases(response, rubric).

    A null rubric isn't judged: nulls. A verdict that can't be read gives
    `absent` (null for rubrics; 0.0 is used for reference answers).
    """
    asked = cases.withColumn("_user", F.concat(F.lit("Rubric:\n"), F.col("rubric"), F.lit("\n\nResponse:\n"), F.coalesce("response", F.lit("")))).withColumn("_system", F.lit('Reply with JSON: {"earned": x, "total": y, "feedback": "..."}'))
    known = asked.withColumnRenamed("response", "_response")
    said = replies(known.where("rubric is not null"), judge, "_system", "_user").withColumn("_j", judge_reply("response"))
    spare = F.lit(absent).cast("double")
    scored = said.select(*cases.columns[:0], *[F.col("_response").alias("response") if c == "response" else F.col(c) for c in cases.columns], F.coalesce("_j.earned", spare).alias("earned"), F.coalesce("_j.total", spare).alias("total"), F.col("_j.feedback").alias("feedback"), F.col("_j.failed").alias("judge_failed"))
    rest = cases.where("rubric is null").select("*", F.lit(None).cast("double").alias("earned"), F.lit(None).cast("double").alias("total"), F.lit(None).cast("string").alias("feedback"), F.lit(False).alias("judge_failed"))
    return scored.unionByName(rest)


def scored_answers(cases: DataFrame, judge: Generate, absent: float | None = None) -> DataFrame:
    """A judge's verdicts (see `judged`) and ROUGE of each response against its rubric without marks; null where there is no rubric."""
    rows = judged(cases, judge, absent)
    found = rouge(F.coalesce("response", F.lit("")), rubric_reference("rubric"))
    return rows.withColumn("_rouge", found).select(*rows.columns, *[F.when(F.col("rubric").isNotNull(), F.col(f"_rouge.{n}")).alias(n) for n in ("rouge1", "rouge2", "rougeL")])


class Chat:
    """A session: each turn retrieves, builds a prompt, asks the model and keeps the history as rows."""

    def __init__(self, retrieve: Callable[[str, str], str], generate: Generate = dry_run, mode: str = "hybrid"):
        self.retrieve, self.generate, self.mode = retrieve, generate, mode
        self.history: list[dict] = []
        self.sources = ""

    def say(self, message: str) -> str:
        if message.startswith("/"):
            return self.command(message)
        context = self.sources = "" if self.mode == "none" else self.retrieve(message, self.mode)
        past = "\n".join(f"{h['role']}: {h['text']}" for h in self.history)
        reply = self.generate(context, f"{past}\nuser: {message}".strip())
        for role, text in (("user", message), ("assistant", reply)):
            self.history.append({"turn": len(self.history), "role": role, "text": text})
        return reply

    def command(self, message: str) -> str:
        """/mode, /sources (of the last turn), /clear, /help and /quit."""
        name, *rest = message[1:].lower().split() or [""]
        if name == "clear":
            self.history.clear()
            return "cleared"
        if name == "mode" and rest and rest[0] in ("none", "vector", "graph", "hybrid"):
            self.mode = rest[0]
            return f"mode {self.mode}"
        if name == "sources":
            return self.sources or "no sources"
        return "/mode none|vector|graph|hybrid, /sources, /clear, /help, /quit" if name != "quit" else "bye"

    def compare(self, message: str) -> dict[str, str]:
        """The reply without context beside that of the current mode."""
        return {"none": self.generate("", f"user: {message}"), self.mode: self.generate(self.retrieve(message, self.mode), f"user: {message}")}
