"""Retrieval and citation metrics, case scores and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.functions import refs, text

METRICS = ("answer_correct", "calculation_steps_present", "citation_fact_precision", "citation_fact_recall", "recall_at_k", "mrr", "recall_at_k_exact", "mrr_exact", "rouge1", "rouge2", "rougeL", "citation_precision", "grounding_rate")


#: What marks a step of a calculation (fixed value).
STEP_MARKS = r"(?i)(?:step\s*\d+|=|\+|-|\*|/|minus|plus|times|divide|therefore|final answer)"


def _round(value: Column) -> Column:
    return F.round(value, 4)


def retrieval_metrics(cases: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Adds recall_at_k, mrr, recall_at_k_exact, mrr_exact, source_recall and source_hits to
    cases(retrieved_ids, relevant_ids[, retrieved_sources]); null where either side is empty.

    The lists are a case's own top k, so all is computed within the row.
    """
    lower = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower)
    wanted, got = F.array_distinct(lower("relevant_ids")), lower("retrieved_ids")
    rows = cases.withColumn("_wanted", wanted).withColumn("_got", got)
    w, g = F.col("_wanted"), F.col("_got")
    some = (F.size(w) > 0) & (F.size(g) > 0)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    exact = F.size(F.filter(g, lambda r: F.array_contains(w, r))) / F.size(w)
    first = F.array_min(F.filter(F.transform(g, lambda r, i: F.when(F.array_contains(w, r), i + 1)), lambda i: i.isNotNull()))
    best_of = lambda r, among: F.array_max(F.transform(among, lambda x: refs.match_score(r, x)))
    hier = total(F.transform(w, lambda r: best_of(r, g))) / F.size(w)
    ranked = F.array_max(F.transform(g, lambda r, i: best_of(r, w) / (i + 1)))
    out = (
        rows.withColumn("recall_at_k", F.when(some, _round(hier)))
        .withColumn("mrr", F.when(some, _round(F.greatest(ranked, F.lit(0.0)))))
        .withColumn("recall_at_k_exact", F.when(some, _round(exact)))
        .withColumn("mrr_exact", F.when(some, _round(F.coalesce(1.0 / first, F.lit(0.0)))))
    )
    if labels is not None:
        named = {k: v.lower() for k, v in labels.items()}
        sources = F.array_sort(F.array_distinct(F.filter(F.transform(w, lambda r: F.when(F.startswith(r, F.lit("26 usc §")), F.lit("usc26")).otherwise(refs.ref_source(r, named))), lambda s: s.isNotNull())))
        had = F.coalesce(F.col("retrieved_sources"), F.array().cast("array<string>"))
        hits = F.map_from_entries(F.transform(F.col("_sources"), lambda s: F.struct(s.alias("key"), F.array_contains(had, s).cast("double").alias("value"))))
        out = out.withColumn("_sources", sources).withColumn("source_hits", F.when(some & (F.size("_sources") > 0), hits))
        out = out.withColumn("source_recall", F.when(some & (F.size("_sources") > 0), _round(total(F.map_values("source_hits")) / F.size("_sources")))).drop("_sources")
    return out.drop("_wanted", "_got")


def citation_metrics(cases: DataFrame, labels: list[str]) -> DataFrame:
    """Adds n_citations, n_supported, citation_precision, citation_sentences, grounded_sentences and grounding_rate to cases(response, retrieved_ids).

    A citation is supported if it equals a retrieved id, case aside; null rates where nothing is cited.
    """
    cited = lambda t: F.array_distinct(F.concat(refs.usc_refs(t), refs.irs_refs(t, labels)))
    rows = cases.withColumn("_had", F.transform(F.coalesce("retrieved_ids", F.array().cast("array<string>")), F.lower))
    rows = rows.withColumn("citations", F.array_sort(cited(F.col("response"))))
    per_sentence = F.transform(text.sentences("response"), lambda s: F.transform(cited(s), F.lower))
    rows = rows.withColumn("_sentences", F.filter(per_sentence, lambda c: F.size(c) > 0))
    supported = F.filter("citations", lambda c: F.array_contains(F.col("_had"), F.lower(c)))
    rows = rows.withColumn("supported_citations", supported).withColumn("n_citations", F.size("citations")).withColumn("n_supported", F.size("supported_citations"))
    grounded = F.size(F.filter("_sentences", lambda c: F.arrays_overlap(c, F.col("_had"))))
    return (
        rows.withColumn("citation_precision", F.when(F.col("n_citations") > 0, _round(F.col("n_supported") / F.col("n_citations"))))
        .withColumn("citation_sentences", F.size("_sentences"))
        .withColumn("grounded_sentences", grounded)
        .withColumn("grounding_rate", F.when(F.col("citation_sentences") > 0, _round(F.col("grounded_sentences") / F.col("citation_sentences"))))
        .drop("_had", "_sentences")
    )


def fact_citations(cases: DataFrame) -> DataFrame:
    """Adds the precision and recall of a response's citations against a case's facts, exact (raw) and with each citation counted for its best fact.

    cases(response, relevant_ids). Of equally good facts the least counts. Without facts precision is 1 if nothing is cited, else 0, and recall is null.
    """
    rows = cases.withColumn("cited_refs", refs.usc_refs("response"))
    facts = F.array_sort(F.array_distinct(F.transform(F.coalesce("relevant_ids", F.array().cast("array<string>")), F.lower)))
    rows = rows.withColumn("_facts", facts).withColumn("_cited", F.transform("cited_refs", F.lower))
    rows = rows.withColumn("_best", F.transform("_cited", lambda c: F.struct(c.alias("c"), refs.best_match(c, F.col("_facts")).alias("m"))))
    hit = F.array_sort(F.array_distinct(F.filter(F.transform("_best", lambda b: F.when(b["m"]["score"] > 0, b["m"]["target"])), lambda t: t.isNotNull())))
    stray = F.array_distinct(F.filter(F.transform("_best", lambda b: F.when(b["m"]["score"] <= 0, b["c"])), lambda t: t.isNotNull()))
    rows = rows.withColumn("matched_refs", hit).withColumn("_keys", F.size("matched_refs") + F.size(stray))
    exact = F.size(F.filter("_cited", lambda c: F.array_contains(F.col("_facts"), c)))
    distinct = F.size(F.array_intersect("_cited", "_facts"))
    none, n_facts, n_cited = F.size("_facts") == 0, F.size("_facts"), F.size("_cited")
    bare = F.when(n_cited == 0, 1.0).otherwise(0.0)
    return (
        rows.withColumn("citation_fact_precision", _round(F.when(none, bare).when(F.col("_keys") > 0, F.size("matched_refs") / F.col("_keys")).otherwise(0.0)))
        .withColumn("citation_fact_recall", F.when(~none, _round(F.size("matched_refs") / n_facts)))
        .withColumn("citation_fact_precision_raw", _round(F.when(none, bare).when(n_cited > 0, exact / n_cited).otherwise(0.0)))
        .withColumn("citation_fact_recall_raw", F.when(~none, _round(distinct / n_facts)))
        .withColumn("n_fact_refs", n_facts)
        .withColumn("n_cited_refs", n_cited)
        .withColumn("n_correct_cited_refs", F.size("matched_refs"))
        .withColumn("n_cited_refs_normalized", F.col("_keys"))
        .drop("_facts", "_cited", "_best", "_keys")
    )


def scored_cases(cases: DataFrame) -> DataFrame:
    """Adds earned, total and answer_correct to cases(expected_type, expected, response, relevant_ids).

    label: 0.75 for the label, 0.25 for a right citation; numeric: 0.6 for the
    number, 0.2 for steps, 0.2 for a citation; string: 0.75 if the reply
    contains the answer, 0.25 for a citation; freeform: null, for a judge.
    """
    rows = fact_citations(cases)
    answer = F.coalesce(text.final_answer("response"), F.col("response"), F.lit(""))
    numbers = text.numbers(answer)
    steps = (F.size(text.numbers("response")) >= 2) & F.coalesce(F.col("response"), F.lit("")).rlike(STEP_MARKS)
    cited = (F.col("n_fact_refs") == 0) | (F.col("n_correct_cited_refs") > 0)
    kind, expected = F.col("expected_type"), F.col("expected")
    money = F.regexp_replace(expected, r"[$,\s]", "")
    right = (
        F.when(kind == "label", F.coalesce(text.predicted_label("response") == F.lower(expected), F.lit(False)))
        .when(kind == "numeric", F.coalesce(F.get(numbers, F.lit(0)) == money, F.lit(False)))
        .when(kind == "string", F.contains(text.normal_string("response"), text.normal_string(expected)))
    )
    rows = rows.withColumn("predicted_label", text.predicted_label("response")).withColumn("calculation_steps_present", F.when(kind == "numeric", steps)).withColumn("citation_correct", cited)
    rows = rows.withColumn("answer_correct", right.cast("double"))
    main = F.when(kind == "numeric", 0.6).otherwise(0.75)
    side = F.when(kind == "numeric", 0.2).otherwise(0.25)
    earned = F.col("answer_correct") * main + F.col("citation_correct").cast("double") * side + F.when(kind == "numeric", F.col("calculation_steps_present").cast("double") * 0.2).otherwise(0.0)
    return rows.withColumn("earned", F.when(kind.isin("label", "numeric", "string"), _round(earned))).withColumn("total", F.when(kind.isin("label", "numeric", "string"), 1.0))


def mode_summary(results: DataFrame, metrics: tuple[str, ...] | None = None) -> DataFrame:
    """One row per dataset, model and mode: case counts, verdicts that can't be read (of judge_failed), score_pct (summed earned over summed total), null-skipping means, unknown_rate."""
    kept = [m for m in (METRICS if metrics is None else metrics) if m in results.columns]
    label = F.col("predicted_label") if "predicted_label" in results.columns else F.lit(None).cast("string")
    scored = F.col("earned").isNotNull()
    total = F.sum(F.when(scored, F.col("total")))
    return results.groupBy("dataset", "model", "mode").agg(
        F.count("*").alias("n_cases"),
        F.count("earned").alias("n_scored"),
        *([F.count_if("judge_failed").alias("n_parse_errors")] if "judge_failed" in results.columns else []),
        _round(F.sum("earned") / F.nullif(total, F.lit(0.0)) * 100).alias("score_pct"),
        *[_round(F.avg(F.col(m).cast("double"))).alias(m) for m in kept],
        _round(F.avg(F.when(label.isNotNull(), (label == "unknown").cast("double")))).alias("unknown_rate"),
    )


def filtered(results: DataFrame, dataset: str | None = None, model: str | None = None) -> DataFrame:
    """The results of one dataset and of the models whose names contain a text."""
    found = results if dataset is None else results.where(F.col("dataset") == dataset)
    return found if model is None else found.where(F.contains("model", F.lit(model)))


def mode_deltas(summary: DataFrame, of: str = "hybrid", against: str = "none") -> DataFrame:
    """dataset, model and the difference of each measure between two modes; null where either is null."""
    keys = ["dataset", "model"]
    measures = [c for c in summary.columns if c not in (*keys, "mode", "n_cases", "n_scored", "n_parse_errors")]
    a = summary.where(F.col("mode") == of).select(*keys, *[F.col(m).alias(f"_a_{m}") for m in measures])
    b = summary.where(F.col("mode") == against).select(*keys, *[F.col(m).alias(f"_b_{m}") for m in measures])
    return a.join(b, keys).select(*keys, *[_round(F.col(f"_a_{m}") - F.col(f"_b_{m}")).alias(m) for m in measures])


def case_winners(results: DataFrame, modes: tuple[str, ...] = ("none", "vector", "graph", "hybrid")) -> DataFrame:
    """dataset, model, case_id, mode, earned: the mode that earned most in each case; of equal ones the first in order."""
    place = F.array_position(F.lit(list(modes)), F.col("mode"))
    order = Window.partitionBy("dataset", "model", "case_id").orderBy(F.desc_nulls_last("earned"), place, "mode")
    return results.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("dataset", "model", "case_id", "mode", "earned")


def source_hit_means(results: DataFrame) -> DataFrame:
    """source, hit_rate: the mean of the cases' source_hits by source."""
    return results.select(F.explode("source_hits").alias("source", "hit")).groupBy("source").agg(_round(F.avg("hit")).alias("hit_rate"))
