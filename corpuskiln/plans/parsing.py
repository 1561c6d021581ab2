"""Queries of the parsers over files made of the test tables' rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.plans import reference
from corpuskiln.session import table
from corpuskiln.sources import cases, documents


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").where("id is not null and text is not null").groupBy("id").agg(F.min(F.struct("source", "title", "text")).alias("r")).select("id", "r.*")
    clean = lambda c: F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^ -~]+", " "))
    return rows.select("id", F.coalesce("source", F.lit("")).alias("source"), clean("title").alias("title"), clean("text").alias("text")).where("text <> '' and title <> ''")


def _number(of: str = "id") -> Column:
    return (F.pmod(F.conv(F.substring(F.md5(of), 1, 6), 16, 10).cast("int"), F.lit(9000)) + 1).cast("string")


def statute_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk as a statute file of one section with two subsections, which is parsed: whole up to 2,000 characters, else by subsection."""
    title, text, n = _escaped(F.col("title")), _escaped(F.col("text")), _number()
    path = F.concat(F.lit("/us/usc/t26/stA/s"), n)
    sub = lambda letter, *inside: [F.lit('<subsection identifier="'), path, F.lit(f'/{letter}">'), *inside, F.lit("</subsection>")]
    xml = F.concat(
        F.lit('<lawDoc><main><subtitle identifier="/us/usc/t26/stA"><section identifier="'), path, F.lit('"><heading> '), title, F.lit(" </heading><sourceCredit>left out</sourceCredit>"),
        *sub("a", F.lit("<heading>First</heading><content>"), text, F.lit(' <ref href="/us/usc/t26/s'), n, F.lit('/b/1">there</ref></content>')), *sub("b", F.lit("<content>"), text, F.lit("</content>")),
        F.lit("</section></subtitle></main></lawDoc>"),
    )
    files = _rows(spark, folder).select(F.col("id").alias("path"), F.encode(xml, "UTF-8").alias("content"))
    found = documents.statute_files(files, 600)
    return found.select(F.col("place.file").alias("file"), "id", "section_id", "title", F.md5("text").alias("digest"), "parent_id", F.array_join("cross_refs", "|").alias("refs"), F.col("place.at").alias("at"))


def publication_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk as a publication file with its text under one title at three depths, one of them too short to be kept."""
    title, text = _escaped(F.col("title")), _escaped(F.col("text"))
    head = F.concat(F.lit("<hd>"), title, F.lit("</hd>"))
    xml = F.concat(F.lit('<pub><sec id="a">'), head, F.lit("<p>"), text, F.lit('</p><sec id="b">'), head, F.lit('<p>short</p><sec id="c">'), head, F.lit("<p>"), text, F.lit("</p><p>"), text, F.lit('</p></sec></sec></sec><sec id="c">'), head, F.lit("<p>"), text, F.lit("</p></sec></pub>"))
    files = _rows(spark, folder).select(F.concat("source", F.lit("/"), "id").alias("source"), F.encode(xml, "UTF-8").alias("content"))
    found = documents.publication_files(files, reference.source_labels(spark, folder))
    return found.select("source", "id", "section_id", "title", F.md5("text").alias("digest"), "hierarchy", "parent_id", F.col("place.at").alias("at"), "error")


def plain_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk as a plain file, named by a section or not."""
    rows = _rows(spark, folder)
    name = F.concat(F.when(_number().endswith("1"), F.lit("/x/file")).otherwise(F.concat(F.lit("/x/section"), _number(), F.lit("_"))), F.col("id"))
    first = F.when(_number().endswith("11"), F.concat(F.lit("§ "), _number(), F.lit(" "))).otherwise(F.lit(""))
    files = rows.select(name.alias("path"), F.encode(F.concat(F.lit("\n  "), first, "title", F.lit("\n"), "text", F.lit(" \n")), "UTF-8").alias("content"))
    return documents.plain_files(files).select("id", "section_id", "title", F.md5("text").alias("digest"), "hierarchy", F.array_join("cross_refs", "|").alias("refs"))


def chunk_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Statute chunks, pages and the rest as three streams of one table with dense numbers."""
    rows = table(spark, folder, "chunks").where("id is not null").select("id", "source", "page_start").distinct()
    placed = rows.withColumn("place", F.struct(F.coalesce("source", F.lit("")).alias("file"), F.coalesce("page_start", F.lit(0)).alias("page"), F.lit(0).cast("long").alias("at")))
    is_statute = F.coalesce(F.col("source") == "usc26", F.lit(False))
    parts = [placed.where(is_statute), placed.where(~is_statute & F.col("page_start").isNotNull()), placed.where(~is_statute & F.col("page_start").isNull())]
    return documents.streams(*parts).select("id", "chunk_ord")


def logic_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out items as logic case files, which are parsed."""
    rows = table(spark, folder, "eval_cases")
    third, money = F.col("item_id") % 3, F.regexp_extract(F.coalesce("rubric", F.lit("")), r"\$([0-9,]+)", 1)
    plain = F.replace(money, F.lit(","), F.lit(""))
    asked = F.when(third == 0, F.concat(F.lit("% Section 151(d) applies to case "), F.col("item_id").cast("string"), F.lit(". Contradiction"))).when(third == 1, F.concat(F.lit("% How much tax is due? $"), money)).otherwise(F.lit("% It holds."))
    goal = F.when(third == 1, F.concat(F.lit(":- tax(bob,2017,"), plain, F.lit(")."))).when(F.col("item_id") % 2 == 0, F.lit(":- \\+ s151(a,_).")).otherwise(F.lit("goal :- \\+ f(a).\n:- goal."))
    said = F.concat(F.lit("% Text\n% "), F.regexp_replace(F.coalesce("context", F.lit("none")), r"\s+", " "), F.lit("\n% Question\n"), asked, F.lit("\n% Facts\nfact("), F.col("item_id").cast("string"), F.lit(").\n% Test\n"), goal, F.lit("\n:- halt.\n"))
    stem = F.concat("id", F.when(F.col("item_id") % 5 == 0, F.lit("_pos")).when(F.col("item_id") % 5 == 1, F.lit("_neg")).otherwise(F.lit("")))
    found = cases.parse_cases(rows.select(stem.alias("id"), said.alias("content")))
    return found.select("id", F.md5("context").alias("context"), "facts", "question", "expected", "expected_type", "test_goal", "test_goal_negated", F.array_join("test_goal_numbers", "|").alias("numbers"))


QUERIES = {f.__name__: f for f in (statute_parse, publication_parse, plain_parse, chunk_streams, logic_cases)}

_CLEAN = "trim(regexp_replace(coalesce({}, ''), '[^ -~]+', ' ', 'g'))"
_ROWS = f"""rows AS (SELECT id, coalesce(r.source, '') AS source, {_CLEAN.format("r.title")} AS title, {_CLEAN.format("r.text")} AS text FROM (SELECT id, min({{'source': source, 'title': title, 'text': text}}) AS r FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id)),
made AS (SELECT *, CAST(CAST('0x' || substr(md5(id), 1, 6) AS INTEGER) % 9000 + 1 AS VARCHAR) AS n FROM rows WHERE text <> '' AND title <> '')"""

SQL = {
    "statute_parse": f"""WITH {_ROWS}, whole AS (SELECT *, '/us/usc/t26/stA/s' || n AS path, title || ' First ' || text || ' there ' || text AS t FROM made)
SELECT id AS file, substr(md5(path), 1, 12) AS id, '26 USC §' || n AS section_id, title, md5(t) AS digest, NULL AS parent_id, '26 USC §' || n || '(b)(1)' AS refs, 0 AS at FROM whole WHERE length(t) <= 600
UNION ALL SELECT id, substr(md5(path || '/a'), 1, 12), '26 USC §' || n || '(a)', title || ' - First', md5('First ' || text || ' there'), '26 USC §' || n, '26 USC §' || n || '(b)(1)', 0 FROM whole WHERE length(t) > 600
UNION ALL SELECT id, substr(md5(path || '/b'), 1, 12), '26 USC §' || n || '(b)', title, md5(text), '26 USC §' || n, '', 1 FROM whole WHERE length(t) > 600""",
    "publication_parse": f"""WITH {_ROWS}, named AS (SELECT source || '/' || id AS source, title, text, upper(source || '/' || id) || ': ' || substr(title, 1, 80) AS name FROM made),
a AS (SELECT source, 'a' AS own, name AS section_id, title, text, NULL AS parent_id FROM named WHERE length(text) >= 100),
c AS (SELECT source, 'c' AS own, CASE WHEN length(text) >= 100 THEN name || ' [c]' ELSE name END AS section_id, title, text || ' ' || text AS text, CASE WHEN length(text) >= 100 THEN name END AS parent_id FROM named WHERE 2 * length(text) + 1 >= 100),
d AS (SELECT source, 'c' AS own, name || ' [c]#2' AS section_id, title, text, NULL AS parent_id FROM named WHERE length(text) >= 100),
every AS (SELECT *, 0 AS i FROM a UNION ALL SELECT *, 1 FROM c UNION ALL SELECT *, 2 FROM d)
SELECT source, substr(md5(source || ':' || own), 1, 12) AS id, section_id, title, md5(text) AS digest, source || '/' || own AS hierarchy, parent_id, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS at, NULL AS error FROM every""",
    "plain_parse": f"""WITH {_ROWS}, named AS (SELECT id, CASE WHEN ends_with(n, '1') THEN 'file' || id ELSE 'section' || n || '_' || id END AS file, CASE WHEN ends_with(n, '11') THEN '§ ' || n || ' ' ELSE '' END || title AS first, text, n FROM made),
read AS (SELECT *, CASE WHEN starts_with(file, 'section') THEN '26 USC §' || n WHEN regexp_matches(first, '§\\s*[0-9]{{1,4}}[A-Z]?') THEN '26 USC §' || regexp_extract(first, '§\\s*([0-9]{{1,4}}[A-Z]?)', 1) END AS ref FROM named)
SELECT substr(md5('sara_source:' || file), 1, 12) AS id, 'SARA Source: ' || coalesce(ref, file) AS section_id, first AS title, md5(first || chr(10) || text) AS digest, 'sara_source/' || file AS hierarchy, coalesce(ref, '') AS refs FROM read""",
    "chunk_streams": "WITH rows AS (SELECT DISTINCT id, source, page_start FROM chunks WHERE id IS NOT NULL) SELECT id, row_number() OVER (ORDER BY CASE WHEN coalesce(source = 'usc26', FALSE) THEN 0 WHEN page_start IS NOT NULL THEN 1 ELSE 2 END, coalesce(source, ''), coalesce(page_start, 0), id) - 1 AS chunk_ord FROM rows",
    "logic_cases": r"""WITH rows AS (SELECT item_id, id || CASE item_id % 5 WHEN 0 THEN '_pos' WHEN 1 THEN '_neg' ELSE '' END AS stem, item_id % 3 AS third, regexp_extract(coalesce(rubric, ''), '\$([0-9,]+)', 1) AS money, trim(regexp_replace(coalesce(context, 'none'), '\s+', ' ', 'g')) AS context FROM eval_cases),
made AS (SELECT *, replace(money, ',', '') AS plain FROM rows)
SELECT stem AS id, md5(context) AS context, 'fact(' || item_id || ').' AS facts,
 CASE third WHEN 0 THEN 'Section 151(d) applies to case ' || item_id || '?' WHEN 1 THEN 'How much tax is due?' ELSE 'It holds.' END AS question,
 CASE third WHEN 0 THEN 'Contradiction' WHEN 1 THEN '$' || money ELSE 'Contradiction' END AS expected, CASE third WHEN 1 THEN 'numeric' ELSE 'label' END AS expected_type,
 CASE WHEN third = 1 THEN 'tax(bob,2017,' || plain || ')' WHEN item_id % 2 = 0 THEN 's151(a,_)' ELSE 'goal' END AS test_goal, third <> 1 AS test_goal_negated,
 CASE WHEN third = 1 THEN '2017|' || plain WHEN item_id % 2 = 0 THEN '51' ELSE '' END AS numbers FROM made WHERE third <> 1 OR money <> ''
UNION ALL SELECT stem, md5(context), 'fact(' || item_id || ').', 'How much tax is due?', '$', 'string', 'tax(bob,2017,)', FALSE, '2017' FROM made WHERE third = 1 AND money = ''""",
}
