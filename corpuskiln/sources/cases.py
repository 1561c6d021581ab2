"""Evaluation sets: rubric lines, reference answers, logic case files and saved results."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln import storage
from corpuskiln.functions.refs import usc_refs
from corpuskiln.operators.order import numbered
from corpuskiln.session import durable

CASE = "id string, context string, facts string, question string, expected string, expected_type string, test_goal string, test_goal_negated boolean, test_goal_numbers array<string>"


def read_rubrics(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """id, question, rubric, relevant_ids of JSON lines (id, question, answer_rubric); blank lines are skipped."""
    rows = spark.read.schema("id string, question string, answer_rubric string").json(path).where("id is not null or question is not null")
    cases = rows.select("id", "question", F.col("answer_rubric").alias("rubric"), usc_refs("answer_rubric").alias("relevant_ids"))
    return cases.orderBy("id").limit(limit) if limit is not None else cases


def read_references(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """id, question, rubric, context, source, filename of a table of reference answers, numbered in file order."""
    rows = spark.read.parquet(path).select("source", "filename", "context", "question", "answer", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    placed = numbered(rows, "_file", "_row", into="_n")
    cases = placed.select(F.concat(F.lit("irs_qa_"), F.col("_n").cast("string")).alias("id"), "_n", "question", F.col("answer").alias("rubric"), "context", "source", "filename")
    return (cases.where(F.col("_n") < limit) if limit is not None else cases).drop("_n")


# --- logic cases ----------------------------------------------------------

#: Numbers of questions and of goals (fixed values).
_NUMBER = re.compile(r"-?\$?\s*(\d[\d,]*(?:\.\d+)?)")
_GOAL_NUMBER = re.compile(r"(?<![A-Za-z_])-?\d+(?:\.\d+)?")
_LABEL = re.compile(r"\b(entailment|contradiction|unknown)\b", re.I)


def signature(term: str) -> tuple[str, int] | None:
    """(name, number of arguments) of a term; commas inside nested brackets don't count."""
    m = re.fullmatch(r"\s*([A-Za-z_]\w*)(?:\((.*)\))?\s*", term, re.S)
    if not m:
        return None
    inner = (m.group(2) or "").strip()
    flat, depth = 0, 0
    for c in inner:
        depth += (c == "(") - (c == ")" and depth > 0)
        flat += c == "," and depth == 0
    return m.group(1), flat + 1 if inner else 0


def test_goal(lines: list[str]) -> tuple[str, bool, list[str]]:
    """(goal, negated, numbers) of the first query in the test clauses; a helper clause whose body is negated negates it."""
    text = "\n".join(x.strip() for x in lines if x.strip())
    clauses = [" ".join(c.split()) for c in re.split(r"(?<=\.)\n|(?<=\.)$", text) if c.strip()]
    heads: dict[tuple[str, int], str] = {}
    queries: list[str] = []
    for c in clauses:
        c = c.removesuffix(".").strip()
        if c.startswith(":-"):
            query = c[2:].strip()
            if query and query.lower() != "halt":
                queries.append(query)
        elif ":-" in c:
            head, body = (x.strip() for x in c.split(":-", 1))
            if s := signature(head):
                heads[s] = body
    if not queries:
        return "", False, []
    negated = queries[0].startswith("\\+")
    goal = queries[0][2:].strip() if negated else queries[0]
    if heads.get(signature(goal) or ("", -1), "").startswith("\\+"):
        negated = True
    return goal, negated, [re.sub(r"[\s,$]", "", n) for n in _GOAL_NUMBER.findall(goal)]


def parse_case(stem: str, text: str) -> dict:
    """A logic case: its "% Text", "% Question", "% Facts" and "% Test" parts and the answer they call for."""
    parts: dict[str, list[str]] = {"Text": [], "Question": [], "Facts": [], "Test": []}
    at = None
    for line in text.splitlines():
        if m := re.match(r"% (Text|Question|Facts|Test)", line):
            at = m.group(1)
        elif at in ("Facts", "Test"):
            parts[at].append(line.strip())
        elif at and line.startswith("%"):
            parts[at].append(line[1:].strip())
    kept = {k: [x for x in v if x] for k, v in parts.items()}
    asked = " ".join(kept["Question"]).strip()
    goal, negated, numbers = test_goal(kept["Test"])
    by_stem = "Entailment" if stem.endswith("_pos") else "Contradiction" if stem.endswith("_neg") else None
    question, expected, label = asked, "", None
    if "?" in asked:
        before, after = asked.rsplit("?", 1)
        question, expected = before.strip() + "?", after.strip()
    if m := _LABEL.search(asked):
        label = m.group(1).capitalize()
        expected = expected or label
        question = asked[: m.start()].strip().rstrip(".")
        if question and not question.endswith("?"):
            question += "?"

    def number(t: str) -> str | None:
        found = _NUMBER.search(t)
        return re.sub(r"[\s,$]", "", found.group(1)) if found else None

    low = asked.lower()
    numeric = "how much" in low or "$" in low or "?" in low and ("tax" in low or "amount" in low)
    if numbers and (number(expected) not in (None, numbers[-1]) or not expected and numeric):
        expected = numbers[-1]
    if not expected:
        if label:
            expected = label
        elif "?" not in asked and (by_stem or goal):
            expected = "Contradiction" if negated else by_stem or "Entailment"
        elif numbers:
            expected = numbers[-1]
        else:
            expected = by_stem or ""
    kind = "label" if _LABEL.fullmatch(expected.strip()) else "numeric" if number(expected) is not None else "string" if expected else "freeform"
    return {
        "id": stem, "context": " ".join(kept["Text"]).strip(), "facts": "\n".join(kept["Facts"]), "question": question or asked, "expected": expected, "expected_type": kind,
        "test_goal": goal, "test_goal_negated": negated, "test_goal_numbers": numbers,
    }


def parse_cases(files: DataFrame) -> DataFrame:
    """Cases of files(id, content)."""

    def parse(frames):
        for f in frames:
            yield pd.DataFrame([parse_case(i, t or "") for i, t in zip(f["id"], f["content"])], columns=[c.split()[0] for c in CASE.split(", ")])

    return files.select("id", "content").mapInPandas(parse, CASE)


def read_cases(spark: SparkSession, split_path: str, case_folder: str, limit: int | None = None) -> DataFrame:
    """The cases a split file lists, one id a line, in its order; ids without a file are skipped and don't count for the limit."""
    listed = spark.read.text(split_path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "id")).select("pos", F.btrim("id").alias("id")).where("id <> ''")
    files = spark.read.text(f"{case_folder}/*.pl", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.pl$", 1).alias("id"), F.col("value").alias("content"))
    cases = listed.join(files, "id")
    cases = cases.orderBy("pos").limit(limit) if limit is not None else cases
    parsed = parse_cases(cases).join(cases.select("id", "pos"), "id")
    return parsed.withColumn("relevant_ids", usc_refs(F.concat_ws(" ", "facts", "question"))).orderBy("pos")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Saved results "<dataset>__<model>__<mode>.json" as one row a case, with dataset, model and mode."""
    rows = spark.read.option("multiLine", True).json(f"{folder}/*__*__*.json").withColumn("_name", F.col("_metadata.file_name"))
    pattern = r"^(.*)__(.*)__([^_]+)\.json$"
    named = rows.select(*[F.regexp_extract("_name", pattern, i + 1).alias(n) for i, n in enumerate(("dataset", "model", "mode"))], F.explode("cases").alias("case"))
    return named.select("dataset", "model", "mode", "case.*") if "mode" not in named.schema["case"].dataType.names else named.select("dataset", "model", *[f"case.{n}" for n in named.schema["case"].dataType.names if n not in ("dataset", "model")])


def write_results(spark: SparkSession, path: str, dataset: str, model: str, mode: str, cases: list[dict], overwrite: bool = False) -> bool:
    """Save one result file; False, and nothing written, if it is there already."""
    target = f"{path}/{dataset}__{model}__{mode}.json"
    if storage.exists(spark, target) and not overwrite:
        return False
    storage.write_text(spark, target, json.dumps({"dataset": dataset, "model": model, "mode": mode, "n_cases": len(cases), "cases": cases}, ensure_ascii=False))
    return True


def save_results(results: DataFrame, path: str, overwrite: bool = False) -> None:
    """Save results as a table partitioned by dataset, model and mode; combinations that are there already are left, or replaced if `overwrite`."""
    spark, keys = results.sparkSession, ["dataset", "model", "mode"]
    rows = results
    if not overwrite and storage.exists(spark, path) and any("=" in n for n in storage.names(spark, path)):
        known = spark.read.parquet(path).select(*[F.col(k).cast("string").alias(k) for k in keys]).distinct()
        rows = durable(results.join(known, keys, "left_anti"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
