"""Queries of text rules, replies, prompts and scores over the test tables, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import prompts, refs, rouge, text
from corpuskiln.operators import evaluation, generation, retrieval, vectors
from corpuskiln.plans import pipeline, reference
from corpuskiln.plans.reference import _RANGE, _RESULTS, _SECTION, _TOP, _stripped
from corpuskiln.session import table
from corpuskiln.sources import cases

QA = "test_tax_form_instructions_qa_pairs"


def text_rules(spark: SparkSession, folder: str) -> DataFrame:
    """First sentences, short titles, keys and guessed titles of chunks."""
    rows = table(spark, folder, "chunks").where("id is not null").select("id", "section_id", "title", "text", "page_start").distinct()
    guessed = text.guessed_title(F.when(F.length("section_id") % 2 == 0, F.col("title")), F.col("text"), F.lit("Label"), F.coalesce("page_start", F.lit(0)))
    return rows.select("id", text.first_sentence("text").alias("first"), text.shortened("title", 20).alias("short"), refs.normal_key("section_id").alias("key"), guessed.alias("guessed")).distinct()


def numeric_questions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, QA).select("qa_id", "question").distinct()
    return rows.select("qa_id", text.is_numeric_question("question").alias("is_numeric"))


def numbers_in_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The numbers of contexts and answers, those of cited sections left out."""
    rows = table(spark, folder, QA).select("qa_id", F.concat_ws(" under section ", "context", "answer").alias("t")).distinct()
    return rows.select("qa_id", F.array_join(text.numbers("t"), "|").alias("numbers"))


def ref_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The source that each edge's target belongs to."""
    labels = reference.source_labels(spark, folder)
    return table(spark, folder, "edges").where("dst is not null").select("dst").distinct().select("dst", refs.ref_source("dst", labels).alias("source"))


def annotated_refs(spark: SparkSession, folder: str) -> DataFrame:
    """References of chunks: their own and those found in their texts."""
    labels = list(reference.source_labels(spark, folder).values())
    rows = table(spark, folder, "chunks").where("id is not null").select("id", "source", "text", "cross_refs").distinct()
    return pipeline.annotated(rows, labels).select("id", F.array_join("cross_refs", "|").alias("refs")).distinct()


def answer_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Final answers and labels read from replies that end with the table's answers."""
    rows = table(spark, folder, QA).select("qa_id", "question", "answer").distinct()
    said = F.concat(F.coalesce("question", F.lit("")), F.when(F.col("qa_id") % 4 == 0, F.lit("\nSo it is ")).otherwise(F.lit("\nFINAL  Answer : ")), F.coalesce("answer", F.lit("")))
    return rows.select("qa_id", text.final_answer(said).alias("answer"), text.predicted_label(said).alias("label"), text.normal_string(said).alias("plain"))


def judge_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts read from fenced and bare JSON of the rubrics' totals, and from the rubrics themselves, which are none."""
    rows = table(spark, folder, "eval_cases").select("item_id", "rubric")
    body = F.to_json(F.struct(text.rubric_total("rubric").alias("earned"), F.lit(1.0).alias("total"), text.rubric_reference("rubric").alias("feedback")))
    raw = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("item_id") % 3 == 1, body).otherwise(F.col("rubric"))
    return rows.select("item_id", text.judge_reply(raw).alias("r")).select("item_id", "r.earned", "r.total", "r.feedback", "r.failed")


def _type(metadata: str = "metadata"):
    return F.get_json_object(metadata, "$.expected_type")


def case_prompts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "eval_cases")
    user = prompts.case_prompt(F.col("question"), F.col("context"), F.col("rubric"), _type(), F.coalesce("relevant_ids", F.array().cast("array<string>")))
    return rows.select("item_id", user.alias("user"), prompts.system_prompt(F.when(F.col("item_id") % 2 == 0, F.col("context"))).alias("system"))


def _cited_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Per statute root, a response that cites the targets of even edges, and the targets of odd ones as facts."""
    rows = table(spark, folder, "edges").where(F.col("dst").startswith("26 USC §")).select("edge_id", "dst", refs.usc_root("dst").alias("root")).distinct()
    some = lambda odd: F.array_sort(F.collect_set(F.when(F.col("edge_id") % 2 == odd, F.col("dst"))))
    found = rows.groupBy("root").agg(some(0).alias("retrieved_ids"), some(1).alias("relevant_ids"))
    told = F.array_join(F.transform("retrieved_ids", lambda d: F.concat(F.lit("section "), F.replace(d, F.lit("26 USC §"), F.lit("")))), " and ")
    return found.withColumn("response", told)


def hierarchical_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieval metrics over statute references, where hierarchical and exact scores differ."""
    return evaluation.retrieval_metrics(_cited_cases(spark, folder)).select("root", "recall_at_k", "mrr", "recall_at_k_exact", "mrr_exact")


def fact_citations(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluation.fact_citations(_cited_cases(spark, folder))
    return found.select("root", F.array_join("matched_refs", "|").alias("matched"), "citation_fact_precision", "citation_fact_recall", "citation_fact_precision_raw", "citation_fact_recall_raw", "n_fact_refs", "n_cited_refs", "n_correct_cited_refs", "n_cited_refs_normalized")


def scored_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out cases scored by rule; replies are made of their rubrics, every third one wrong."""
    rows = table(spark, folder, "eval_cases")
    third, kind = F.col("item_id") % 3, _type()
    money, name = F.regexp_extract("rubric", r"(\$[0-9,]+)", 1), F.regexp_extract("rubric", r"Names ([^.]+)\.", 1)
    expected = F.when(kind == "numeric", money).when(kind == "label", F.lit("Contradiction")).when(kind == "string", name)
    final = (
        F.when(kind == "numeric", F.when(third == 0, F.lit("$1,000")).otherwise(money))
        .when(kind == "label", F.when(third == 0, F.lit("Entailment.")).when(third == 1, F.lit("not entailed")).otherwise(F.lit("contradictory")))
        .otherwise(F.when(third == 0, F.lit("nothing")).otherwise(name))
    )
    reply = F.concat(F.lit("Step 1: "), F.coalesce(text.rubric_reference("rubric"), F.lit("")), F.lit("\nFinal Answer: "), F.coalesce(final, F.lit("")))
    made = rows.select("item_id", kind.alias("expected_type"), expected.alias("expected"), reply.alias("response"), "relevant_ids")
    return evaluation.scored_cases(made).select("item_id", "expected_type", "predicted_label", "calculation_steps_present", "citation_correct", "answer_correct", "earned", "total")


def _with_sources(spark: SparkSession, folder: str) -> DataFrame:
    labels = reference.source_labels(spark, folder)
    of = F.create_map(*[F.lit(x) for s, label in labels.items() for x in (label, s)])
    found = reference._retrieved(spark, folder).withColumn("retrieved_sources", F.transform("retrieved_ids", lambda r: of[r]))
    return evaluation.retrieval_metrics(found, labels)


def source_recall(spark: SparkSession, folder: str) -> DataFrame:
    return _with_sources(spark, folder).select("item_id", "source_recall", F.array_join(F.array_sort(F.map_keys("source_hits")), "|").alias("sources"))


def source_hit_means(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.source_hit_means(_with_sources(spark, folder))


def retrieval_modes(spark: SparkSession, folder: str) -> DataFrame:
    """The hits of every mode over the same vector and graph hits."""
    rows, asked = reference._vectors(spark, folder)
    queries = asked.select("query_id", F.lit("no citation here").alias("text"))
    v = vectors.top_k(rows, asked, 20).select("query_id", F.concat(F.lit("v"), F.col("item").cast("string")).alias("section_id"), F.round("score", 4).alias("vector_score"))
    g = v.select("query_id", F.concat("section_id", F.lit("g")).alias("section_id"), (F.col("vector_score") / 2).alias("graph_score"))
    whole = None
    for mode in retrieval.MODES:
        part = retrieval.retrieve(mode, queries, v, g, 10).select(F.lit(mode).alias("mode"), "query_id", "section_id", "rank", F.round("score", 4).alias("score"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def _failing(system: str, user: str) -> str:
    """A stand-in for a model: fails for prompts of a length that seven divides."""
    if len(user) % 7 == 0:
        raise TimeoutError("no reply")
    return generation.dry_run(system, user)


def batch_replies(spark: SparkSession, folder: str) -> DataFrame:
    """The prompts of held-out cases run as a batch, errors kept by case."""
    found = generation.replies(case_prompts(spark, folder), _failing)
    return found.select("item_id", "response", "error")


def _verdict(system: str, user: str) -> str:
    """A stand-in for a judge: earned by the length of what it sees, and now and then no verdict."""
    return "no verdict" if len(user) % 5 == 0 else json.dumps({"earned": len(user) % 4, "total": 4, "feedback": f"{len(user)} characters"})


def judged_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Questions judged as replies against their rubrics; null rubrics aren't judged."""
    rows = table(spark, folder, "eval_cases").select("item_id", F.col("question").alias("response"), "rubric")
    return generation.judged(rows, _verdict, 0.0).select("item_id", "earned", "total", "feedback", "judge_failed")


def rouge_scores(spark: SparkSession, folder: str) -> DataFrame:
    """ROUGE of each answer against its context, as the scores of a set of reference answers have it."""
    rows = table(spark, folder, QA).select("qa_id", "answer", "context").distinct()
    found = rouge.rouge(F.coalesce("answer", F.lit("")), F.coalesce("context", F.lit("")))
    return rows.select("qa_id", found.alias("r")).select("qa_id", "r.rouge1", "r.rouge2", "r.rougeL")


def filtered_results(spark: SparkSession, folder: str) -> DataFrame:
    """The results of one dataset and of models by a part of their names, summed up."""
    found = evaluation.filtered(reference._results(spark, folder), "events", "1")
    return found.groupBy("dataset", "model", "mode").agg(F.count("*").alias("n"), F.count("earned").alias("n_scored"))


def reference_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation set of reference answers, numbered in file order."""
    return cases.read_references(spark, f"{folder}/{QA}.parquet").select("id", "question", "rubric", "source", "filename")


QUERIES = {
    f.__name__: f
    for f in (
        text_rules, numeric_questions, numbers_in_answers, ref_sources, annotated_refs, answer_labels, judge_replies, case_prompts, hierarchical_metrics, fact_citations, scored_cases, source_recall, source_hit_means,
        retrieval_modes, batch_replies, judged_cases, rouge_scores, filtered_results, reference_cases,
    )
}


def _numbers(source: str, keys: str) -> str:
    """keys, numbers: the kept numbers of column t of a source."""
    pattern = r"-?\$?\s*[0-9][0-9,]*(?:\.[0-9]+)?"
    back = "lower(right(array_to_string([b[j] || f[j] for j in range(1, i)], '') || b[i], 16))"
    return rf"""SELECT {keys}, [regexp_replace(f[i], '[-$,\s]', '', 'g') for i in range(1, len(f) + 1) if NOT (contains({back}, '§') OR ends_with(rtrim({back}), 'section'))] AS numbers
FROM (SELECT {keys}, regexp_extract_all(t, '({pattern})', 1) AS f, regexp_split_to_array(t, '{pattern}') AS b FROM {source})"""


def _plain(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _said(t: str, booleans: bool) -> str:
    more = f" WHEN regexp_matches({t}, '^(?:true|yes)(?: |$)') THEN 'entailment' WHEN regexp_matches({t}, '^(?:false|no)(?: |$)') THEN 'contradiction'" if booleans else ""
    return rf"""CASE WHEN regexp_matches({t}, '\b(?:unknown|indeterminate|cannot determine|insufficient information)\b') THEN 'unknown' WHEN regexp_matches({t}, '\b(?:not entailment|not entailed|does not entail)\b') THEN 'contradiction'
 WHEN regexp_matches({t}, '\b(?:not contradiction|not contradictory)\b') THEN 'entailment' WHEN regexp_matches({t}, '\b(?:contradiction|contradictory|contradicts|contradict)\b') THEN 'contradiction' WHEN regexp_matches({t}, '\b(?:entailment|entailed|entails)\b') THEN 'entailment'{more} END"""


def _final(t: str) -> str:
    return "nullif(" + _stripped(rf"regexp_extract({t}, '(?im)final\s+answer\s*:\s*(.+)$', 1)") + ", '')"


def _score(a: str, b: str) -> str:
    section = lambda x: f"regexp_extract({x}, '^26 usc ?§ ?([0-9]{{1,4}}[a-z]?)', 1)"
    parts = lambda x: rf"regexp_extract_all({x}, '\(([a-z0-9]+)\)', 1)"
    shared = f"least(len({parts(a)}), len({parts(b)}))"
    return f"""CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {section(a)} = '' OR {section(b)} = '' OR {section(a)} <> {section(b)} THEN 0.0
 WHEN {parts(a)}[1:{shared}] = {parts(b)}[1:{shared}] THEN CASE WHEN abs(len({parts(a)}) - len({parts(b)})) = 1 THEN 0.75 ELSE 0.5 END WHEN {parts(a)}[1] = {parts(b)}[1] THEN 0.25 ELSE 0.0 END"""


_REFERENCE = r"trim(regexp_replace(coalesce(rubric, ''), '\[\+[0-9]+(?:\.[0-9]+)?\]\s*', '', 'g'))"
_TOTAL = r"round(coalesce(list_sum(list_transform(regexp_extract_all(coalesce(rubric, ''), '\[\+([0-9]+(?:\.[0-9]+)?)\]', 1), lambda x: CAST(x AS DOUBLE))), 0.0), 4)"
_TYPE = "json_extract_string(metadata, '$.expected_type')"
_CASES = r"""rows AS (SELECT DISTINCT edge_id, dst, regexp_extract(dst, '^(26 USC §[0-9]+[A-Z]?)', 1) AS root FROM edges WHERE starts_with(dst, '26 USC §')),
roots AS (SELECT DISTINCT nullif(root, '') AS root FROM rows), got AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY dst) AS rank FROM (SELECT DISTINCT nullif(root, '') AS root, dst FROM rows WHERE edge_id % 2 = 0)),
want AS (SELECT DISTINCT nullif(root, '') AS root, lower(dst) AS fact FROM rows WHERE edge_id % 2 = 1)"""

SQL = {
    "text_rules": rf"""SELECT DISTINCT id, {_stripped("CASE WHEN regexp_matches(coalesce(text, ''), '[.!?]') THEN regexp_extract(text, '(?s)^(.*?[.!?])', 1) ELSE substr(coalesce(text, ''), 1, 120) END")} AS first,
 CASE WHEN length(title) <= 20 THEN title ELSE rtrim(substr(title, 1, 17)) || '...' END AS short, regexp_replace(replace(trim(lower(coalesce(section_id, ''))), '.', ''), '\s+', ' ', 'g') AS key,
 coalesce(nullif(substr({_stripped("coalesce(CASE WHEN length(section_id) % 2 = 0 THEN title END, '')")}, 1, 96), ''), nullif(substr(array_to_string(list_slice(string_split(regexp_replace({_stripped("split_part(coalesce(text, ''), '.', 1)")}, '\s+', ' ', 'g'), ' '), 1, 14), ' '), 1, 96), ''), 'Label Page ' || coalesce(page_start, 0)) AS guessed
 FROM chunks WHERE id IS NOT NULL""",
    "numeric_questions": f"SELECT DISTINCT qa_id, contains(q, 'how much') OR contains(q, '$') OR (contains(q, '?') AND (contains(q, 'tax') OR contains(q, 'amount'))) AS is_numeric FROM (SELECT qa_id, lower(coalesce(question, '')) AS q FROM {QA})",
    "numbers_in_answers": f"WITH rows AS (SELECT DISTINCT qa_id, concat_ws(' under section ', context, answer) AS t FROM {QA}) SELECT qa_id, array_to_string(numbers, '|') AS numbers FROM ({_numbers('rows', 'qa_id')})",
    "ref_sources": "SELECT d.dst, CASE WHEN starts_with(d.dst, '26 USC §') THEN 'usc26' ELSE min(l.source) END AS source FROM (SELECT DISTINCT dst FROM edges WHERE dst IS NOT NULL) d LEFT JOIN source_labels l ON starts_with(d.dst, l.label) GROUP BY d.dst",
    "annotated_refs": rf"""WITH rows AS (SELECT DISTINCT id, source, text, cross_refs FROM chunks WHERE id IS NOT NULL),
own AS (SELECT id, unnest(cross_refs) AS ref FROM rows),
single AS (SELECT id, unnest(regexp_extract_all(text, '{_SECTION}', 1)) AS n, unnest(regexp_extract_all(text, '{_SECTION}', 2)) AS s FROM rows WHERE source <> 'usc26'),
spans AS (SELECT id, CAST(unnest(regexp_extract_all(text, '{_RANGE}', 1)) AS INTEGER) AS a, CAST(unnest(regexp_extract_all(text, '{_RANGE}', 2)) AS INTEGER) AS b FROM rows WHERE source <> 'usc26'),
pubs AS (SELECT id, lower(unnest(regexp_extract_all(text, '(?i)(?:publication|pub\.?)\s+([0-9]{{1,4}}[a-z]?)', 1))) AS x FROM rows WHERE source <> 'usc26'),
forms AS (SELECT id, lower(unnest(regexp_extract_all(text, '(?i)form\s+([0-9]{{3,5}}(?:-[a-z0-9]{{1,4}})?)', 1))) AS x FROM rows WHERE source <> 'usc26'),
scheds AS (SELECT id, lower(unnest(regexp_extract_all(text, '(?i)(?:schedule|sch\.?)\s+([a-z]{{1,4}}|[0-9]{{1,4}})', 1))) AS x FROM rows WHERE source <> 'usc26'),
found AS (SELECT id, ref FROM own UNION SELECT id, '26 USC §' || n || coalesce(s, '') FROM single UNION SELECT id, '26 USC §' || i FROM spans, LATERAL (SELECT unnest(range(a, b + 1)) AS i) WHERE a <= b AND b - a <= 60
 UNION SELECT id, label FROM pubs JOIN source_labels ON lower(label) = 'irs pub. ' || x UNION SELECT id, label FROM forms JOIN source_labels ON lower(label) = 'form ' || x || ' instructions' OR replace(lower(label), '-', '') = 'form ' || replace(x, '-', '') || ' instructions'
 UNION SELECT id, label FROM scheds JOIN source_labels ON lower(label) = 'sch. ' || x || ' instructions'),
listed AS (SELECT id, string_agg(ref, '|' ORDER BY ref) AS refs FROM found WHERE ref IS NOT NULL GROUP BY id)
SELECT DISTINCT id, CASE WHEN source = 'usc26' THEN array_to_string(cross_refs, '|') ELSE coalesce(refs, '') END AS refs FROM rows LEFT JOIN listed USING (id)""",
    "answer_labels": f"""WITH rows AS (SELECT DISTINCT qa_id, coalesce(question, '') || CASE WHEN qa_id % 4 = 0 THEN chr(10) || 'So it is ' ELSE chr(10) || 'FINAL  Answer : ' END || coalesce(answer, '') AS r FROM {QA}),
read AS (SELECT qa_id, {_final('r')} AS answer, {_plain('r')} AS plain FROM rows), plained AS (SELECT *, {_plain('answer')} AS p FROM read)
SELECT qa_id, answer, coalesce({_said('p', True)}, {_said('plain', False)}) AS label, plain FROM plained""",
    "judge_replies": f"""WITH made AS (SELECT item_id, rubric, to_json({{'earned': {_TOTAL}, 'total': 1.0, 'feedback': {_REFERENCE}}}) AS body FROM eval_cases),
raw AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 1 THEN CAST(body AS VARCHAR) ELSE rubric END AS r FROM made),
bare AS (SELECT item_id, regexp_replace(r, '^```json\\s*|\\s*```$', '', 'g') AS b FROM raw), parsed AS (SELECT item_id, CASE WHEN starts_with(b, '{{') AND ends_with(b, '}}') THEN TRY_CAST(b AS JSON) END AS j FROM bare)
SELECT item_id, CAST(json_extract(j, '$.earned') AS DOUBLE) AS earned, CAST(json_extract(j, '$.total') AS DOUBLE) AS total, json_extract_string(j, '$.feedback') AS feedback, j IS NULL AS failed FROM parsed""",
    "case_prompts": rf"""SELECT item_id, concat_ws(chr(10) || chr(10), 'Text:' || chr(10) || coalesce(nullif(context, ''), '(none)'), 'Facts:' || chr(10) || coalesce(nullif(rubric, ''), '(none)'), 'Question:' || chr(10) || question,
 'Citations allowed:' || chr(10) || CASE WHEN len(relevant_ids) > 0 THEN array_to_string(relevant_ids, ', ') ELSE 'None' END,
 CASE {_TYPE} WHEN 'numeric' THEN 'Show the steps of the calculation.' || chr(10) || 'End with: Final Answer: <number>.'
  WHEN 'label' THEN 'Final Answer must be exactly one of: Entailment, Contradiction' || CASE WHEN regexp_matches(lower(question), '\b(?:unknown|indeterminate|cannot\s+determine|insufficient\s+information)\b') THEN ', Unknown' ELSE '' END || '.' ELSE 'End with: Final Answer: <value or label>.' END) AS user,
 CASE WHEN item_id % 2 = 0 AND coalesce(context, '') <> '' THEN 'You answer questions about tax law from these excerpts and cite their section ids.' || chr(10) || chr(10) || 'Excerpts:' || chr(10) || chr(10) || context ELSE 'You answer questions about tax law. Say so if you don''t know.' END AS system FROM eval_cases""",
    "hierarchical_metrics": f"""WITH {_CASES}, n AS (SELECT root, count(*) AS n FROM want GROUP BY 1), scored AS (SELECT root, fact, lower(dst) AS dst, rank, {_score('fact', 'lower(dst)')} AS s FROM want JOIN got USING (root)),
recalled AS (SELECT root, sum(s) AS s FROM (SELECT root, fact, max(s) AS s FROM scored GROUP BY 1, 2) GROUP BY 1), ranked AS (SELECT root, max(s / rank) AS m FROM scored GROUP BY 1),
hit AS (SELECT root, count(*) AS h, min(rank) AS r FROM scored WHERE fact = dst GROUP BY 1)
SELECT root, round(s / n, 4) AS recall_at_k, round(m, 4) AS mrr, CASE WHEN s IS NOT NULL THEN round(coalesce(h, 0) / n, 4) END AS recall_at_k_exact, CASE WHEN s IS NOT NULL THEN round(coalesce(1.0 / r, 0.0), 4) END AS mrr_exact
FROM roots LEFT JOIN n USING (root) LEFT JOIN recalled USING (root) LEFT JOIN ranked USING (root) LEFT JOIN hit USING (root)""",
    "fact_citations": f"""WITH {_CASES}, told AS (SELECT root, string_agg('section ' || replace(dst, '26 USC §', ''), ' and ' ORDER BY dst) AS t FROM got GROUP BY 1),
cited AS (SELECT DISTINCT root, lower('26 USC §' || n || coalesce(s, '')) AS c FROM (SELECT root, unnest(regexp_extract_all(t, '{_SECTION}', 1)) AS n, unnest(regexp_extract_all(t, '{_SECTION}', 2)) AS s FROM told)),
scored AS (SELECT root, c, fact, {_score('c', 'fact')} AS s FROM cited JOIN want USING (root)),
best AS (SELECT root, c, fact, s FROM (SELECT *, row_number() OVER (PARTITION BY root, c ORDER BY s DESC, fact) AS rn FROM scored) WHERE rn = 1 AND s > 0),
per AS (SELECT root, count(DISTINCT c) AS n_cited FROM cited GROUP BY 1), facts AS (SELECT root, count(*) AS n_facts FROM want GROUP BY 1),
matched AS (SELECT root, string_agg(DISTINCT fact, '|' ORDER BY fact) AS matched, count(DISTINCT fact) AS n_matched, count(DISTINCT c) AS n_used FROM best GROUP BY 1),
exact AS (SELECT cited.root, count(*) AS n_exact FROM cited JOIN want ON cited.root = want.root AND c = fact GROUP BY 1),
every AS (SELECT root, coalesce(n_cited, 0) AS nc, coalesce(n_facts, 0) AS nf, coalesce(matched, '') AS matched, coalesce(n_matched, 0) AS nm, coalesce(n_cited, 0) - coalesce(n_used, 0) + coalesce(n_matched, 0) AS nk, coalesce(n_exact, 0) AS ne
 FROM roots LEFT JOIN per USING (root) LEFT JOIN facts USING (root) LEFT JOIN matched USING (root) LEFT JOIN exact USING (root))
SELECT root, matched, round(CASE WHEN nf = 0 THEN CASE WHEN nc = 0 THEN 1.0 ELSE 0.0 END WHEN nk > 0 THEN nm / nk ELSE 0.0 END, 4) AS citation_fact_precision, CASE WHEN nf > 0 THEN round(nm / nf, 4) END AS citation_fact_recall,
 round(CASE WHEN nf = 0 THEN CASE WHEN nc = 0 THEN 1.0 ELSE 0.0 END WHEN nc > 0 THEN ne / nc ELSE 0.0 END, 4) AS citation_fact_precision_raw, CASE WHEN nf > 0 THEN round(ne / nf, 4) END AS citation_fact_recall_raw,
 nf AS n_fact_refs, nc AS n_cited_refs, nm AS n_correct_cited_refs, nk AS n_cited_refs_normalized FROM every""",
    "scored_cases": rf"""WITH rows AS (SELECT item_id, {_TYPE} AS kind, regexp_extract(rubric, '(\$[0-9,]+)', 1) AS money, regexp_extract(rubric, 'Names ([^.]+)\.', 1) AS name, {_REFERENCE} AS reference, coalesce(len(list_distinct(relevant_ids)), 0) AS n_facts, rubric FROM eval_cases),
made AS (SELECT *, CASE kind WHEN 'numeric' THEN money WHEN 'label' THEN 'Contradiction' WHEN 'string' THEN name END AS expected,
 CASE kind WHEN 'numeric' THEN CASE WHEN item_id % 3 = 0 THEN '$1,000' ELSE money END WHEN 'label' THEN CASE item_id % 3 WHEN 0 THEN 'Entailment.' WHEN 1 THEN 'not entailed' ELSE 'contradictory' END ELSE CASE WHEN item_id % 3 = 0 THEN 'nothing' ELSE name END END AS f FROM rows),
replied AS (SELECT *, 'Step 1: ' || reference || chr(10) || 'Final Answer: ' || coalesce(f, '') AS response FROM made),
read AS (SELECT *, {_final('response')} AS answer FROM replied), of_answer AS (SELECT item_id, coalesce(answer, response) AS t FROM read), of_reply AS (SELECT item_id, response AS t FROM read),
a AS ({_numbers('of_answer', 'item_id')}), b AS ({_numbers('of_reply', 'item_id')}),
judged AS (SELECT item_id, kind, coalesce({_said(_plain('answer'), True)}, {_said(_plain('response'), False)}) AS label, len(b.numbers) >= 2 AND regexp_matches(response, '(?i)(?:step\s*\d+|=|\+|-|\*|/|minus|plus|times|divide|therefore|final answer)') AS steps, n_facts = 0 AS cited,
 CASE kind WHEN 'label' THEN 1.0 WHEN 'numeric' THEN CAST(coalesce(a.numbers[1] = regexp_replace(expected, '[$,\s]', '', 'g'), expected IS NULL AND FALSE) AS DOUBLE) WHEN 'string' THEN CAST(contains({_plain('response')}, {_plain('expected')}) AS DOUBLE) END AS correct FROM read JOIN a USING (item_id) JOIN b USING (item_id)),
fixed AS (SELECT * REPLACE (CASE WHEN kind = 'label' THEN CAST(coalesce(label = 'contradiction', FALSE) AS DOUBLE) ELSE correct END AS correct) FROM judged)
SELECT item_id, kind AS expected_type, label AS predicted_label, CASE WHEN kind = 'numeric' THEN steps END AS calculation_steps_present, cited AS citation_correct, correct AS answer_correct,
 CASE kind WHEN 'numeric' THEN round(correct * 0.6 + CAST(cited AS INTEGER) * 0.2 + CAST(steps AS INTEGER) * 0.2, 4) WHEN 'label' THEN round(correct * 0.75 + CAST(cited AS INTEGER) * 0.25, 4) WHEN 'string' THEN round(correct * 0.75 + CAST(cited AS INTEGER) * 0.25, 4) END AS earned,
 CASE WHEN kind IN ('label', 'numeric', 'string') THEN 1.0 END AS total FROM fixed""",
    "retrieval_modes": f"""WITH {_TOP}, v AS (SELECT query_id, 'v' || item AS section_id, round(s, 4) AS vs FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) AS n FROM top) WHERE n <= 20),
hits AS (SELECT 'vector' AS mode, query_id, section_id, 0.6::DOUBLE * vs AS score, 0 AS g FROM v UNION ALL SELECT 'graph', query_id, section_id || 'g', (1 - 0.6::DOUBLE) * (vs / 2), 1 FROM v
 UNION ALL SELECT 'hybrid', query_id, section_id, 0.6::DOUBLE * vs, 0 FROM v UNION ALL SELECT 'hybrid', query_id, section_id || 'g', (1 - 0.6::DOUBLE) * (vs / 2), 1 FROM v)
SELECT mode, query_id, section_id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, g, section_id) AS rank FROM hits) WHERE rank <= 10""",
    "reference_cases": f"SELECT 'irs_qa_' || (row_number() OVER () - 1) AS id, question, answer AS rubric, source, filename FROM {QA}",
}
_SOURCES = """l AS (SELECT source, label, row_number() OVER (ORDER BY label) - 1 AS n FROM source_labels), got AS (SELECT item_id, source FROM eval_cases, LATERAL (SELECT unnest(range(0, 10)) AS j) JOIN l ON (item_id * 7 + j * 5) % 44 = n),
want AS (SELECT DISTINCT item_id, l.source FROM (SELECT item_id, lower(unnest(relevant_ids)) AS r FROM eval_cases) w JOIN l ON starts_with(r, lower(label))),
hits AS (SELECT item_id, source, CASE WHEN (item_id, source) IN (SELECT (item_id, source) FROM got) THEN 1.0::DOUBLE ELSE 0.0 END AS hit FROM want)"""
SQL |= {
    "citation_metrics": rf"""WITH texts AS (SELECT item_id, -1 AS pos, coalesce(rubric, '') AS t FROM eval_cases UNION ALL
  SELECT item_id, i, p[i] FROM (SELECT item_id, string_split(regexp_replace(rubric, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM eval_cases WHERE rubric IS NOT NULL), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)),
single AS (SELECT item_id, pos, unnest(regexp_extract_all(t, '{_SECTION}', 1)) AS n, unnest(regexp_extract_all(t, '{_SECTION}', 2)) AS s FROM texts),
spans AS (SELECT item_id, pos, CAST(unnest(regexp_extract_all(t, '{_RANGE}', 1)) AS INTEGER) AS a, CAST(unnest(regexp_extract_all(t, '{_RANGE}', 2)) AS INTEGER) AS b FROM texts),
pubs AS (SELECT item_id, pos, lower(unnest(regexp_extract_all(t, '(?i)(?:publication|pub\.?)\s+([0-9]{{1,4}}[a-z]?)', 1))) AS x FROM texts),
forms AS (SELECT item_id, pos, lower(unnest(regexp_extract_all(t, '(?i)form\s+([0-9]{{3,5}}(?:-[a-z0-9]{{1,4}})?)', 1))) AS x FROM texts),
scheds AS (SELECT item_id, pos, lower(unnest(regexp_extract_all(t, '(?i)(?:schedule|sch\.?)\s+([a-z]{{1,4}}|[0-9]{{1,4}})', 1))) AS x FROM texts),
cites AS (SELECT item_id, pos, '26 USC §' || n || coalesce(s, '') AS ref FROM single UNION SELECT item_id, pos, '26 USC §' || i FROM spans, LATERAL (SELECT unnest(range(a, b + 1)) AS i) WHERE a <= b AND b - a <= 60
 UNION SELECT item_id, pos, label FROM pubs JOIN source_labels ON lower(label) = 'irs pub. ' || x UNION SELECT item_id, pos, label FROM forms JOIN source_labels ON lower(label) = 'form ' || x || ' instructions' OR replace(lower(label), '-', '') = 'form ' || replace(x, '-', '') || ' instructions'
 UNION SELECT item_id, pos, label FROM scheds JOIN source_labels ON lower(label) = 'sch. ' || x || ' instructions'),
l AS (SELECT lower(label) AS label, row_number() OVER (ORDER BY label) - 1 AS n FROM source_labels),
got AS (SELECT item_id, label FROM eval_cases, LATERAL (SELECT unnest(range(0, 10)) AS j) JOIN l ON (item_id * 7 + j * 5) % 44 = n),
held AS (SELECT *, (item_id, lower(ref)) IN (SELECT (item_id, label) FROM got) AS had FROM cites),
whole AS (SELECT item_id, count(*) AS n_citations, count_if(had) AS n_supported FROM held WHERE pos = -1 GROUP BY 1),
per AS (SELECT item_id, count(*) AS citation_sentences, count_if(had) AS grounded_sentences FROM (SELECT item_id, pos, bool_or(had) AS had FROM held WHERE pos >= 0 GROUP BY 1, 2) GROUP BY 1)
SELECT item_id, coalesce(n_citations, 0) AS n_citations, coalesce(n_supported, 0) AS n_supported, round(n_supported / n_citations, 4) AS citation_precision, coalesce(citation_sentences, 0) AS citation_sentences, coalesce(grounded_sentences, 0) AS grounded_sentences, round(grounded_sentences / citation_sentences, 4) AS grounding_rate
FROM eval_cases LEFT JOIN whole USING (item_id) LEFT JOIN per USING (item_id)""",
    "source_recall": f"WITH {_SOURCES}, per AS (SELECT item_id, round(avg(hit), 4) AS source_recall, string_agg(source, '|' ORDER BY source) AS sources FROM hits GROUP BY 1) SELECT item_id, source_recall, sources FROM eval_cases LEFT JOIN per USING (item_id)",
    "source_hit_means": f"WITH {_SOURCES} SELECT source, round(avg(hit), 4) AS hit_rate FROM hits GROUP BY 1",
}
SQL |= {
    "batch_replies": f"WITH p AS ({SQL['case_prompts']}) SELECT item_id, CASE WHEN length(\"user\") % 7 <> 0 THEN '[dry run] ' || length(system) || ' + ' || length(\"user\") || ' characters' END AS response, CASE WHEN length(\"user\") % 7 = 0 THEN 'TimeoutError: no reply' END AS error FROM p",
    "judged_cases": """WITH p AS (SELECT item_id, rubric, length('Rubric:' || chr(10) || rubric || chr(10) || chr(10) || 'Response:' || chr(10) || coalesce(question, '')) AS n FROM eval_cases)
SELECT item_id, CASE WHEN rubric IS NOT NULL THEN CASE WHEN n % 5 = 0 THEN 0.0 ELSE n % 4 END END AS earned, CASE WHEN rubric IS NOT NULL THEN CASE WHEN n % 5 = 0 THEN 0.0 ELSE 4.0 END END AS total,
 CASE WHEN rubric IS NOT NULL AND n % 5 <> 0 THEN n || ' characters' END AS feedback, coalesce(rubric IS NOT NULL AND n % 5 = 0, FALSE) AS judge_failed FROM p""",
    "filtered_results": f"WITH {_RESULTS} SELECT dataset, model, mode, count(*) AS n, count(earned) AS n_scored FROM results WHERE dataset = 'events' AND contains(model, '1') GROUP BY ALL",
}
