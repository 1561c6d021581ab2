"""Parsers, discovery, evaluation sets, pipeline, generation and streaming."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpuskiln import config
from corpuskiln.functions import text
from corpuskiln.operators import evaluation, generation, orphans
from corpuskiln.plans import pipeline
from corpuskiln.plans.engine import Engine
from corpuskiln.sources import cases, documents
from corpuskiln.streaming import refresh

NS = 'xmlns="http://xml.house.gov/schemas/uslm/1.0"'
STATUTE = f"""<lawDoc {NS}><main><subtitle identifier="/us/usc/t26/stA">
<section identifier="/us/usc/t26/stA/s1"><heading> Tax imposed </heading><content>one <b>two</b> three<note>no</note> tail</content><ref href="/us/usc/t26/s61/a">x</ref><ref href="/us/usc/t42/s1">y</ref></section>
<section identifier="/us/usc/t26/stA/s2"><heading>Long</heading><chapeau>{'intro ' * 30}</chapeau>
<subsection identifier="/us/usc/t26/stA/s2/a"><heading>First</heading><content>alpha</content></subsection>
<subsection identifier="/us/usc/t26/stA/s2/b"><content>beta</content></subsection></section>
<section identifier="/us/usc/t26/stA/s1400Z-2"><heading>no</heading></section></subtitle></main></lawDoc>"""


def test_statute_chunks():
    made = list(documents.statute_chunks(STATUTE.encode(), 100))
    assert [(c["section_id"], c["title"], c["parent_id"]) for c in made] == [("/us/usc/t26/stA/s1", "Tax imposed", None), ("/us/usc/t26/stA/s2/a", "Long - First", "/us/usc/t26/stA/s2"), ("/us/usc/t26/stA/s2/b", "Long", "/us/usc/t26/stA/s2")]
    assert made[0]["text"] == "Tax imposed one two three tail x y" and made[0]["cross_refs"] == ["/us/usc/t26/s61/a"]
    assert made[0]["id"] == documents.short_hash("/us/usc/t26/stA/s1")
    with pytest.raises(ValueError):
        list(documents.statute_chunks(b"<a/>"))


def test_publication_chunks():
    para = "<p>" + "word " * 30 + "</p>"
    xml = f'<pub><sec id="a"><hd>Intro</hd>{para}<sec id="b"><hd>Short</hd><p>no</p><sec id="c"><hd>Intro</hd>{para}</sec></sec></sec><sec id="d"><hd>Intro</hd>{para}</sec><sec id="d"><hd>Intro</hd>{para}</sec></pub>'
    made = list(documents.publication_chunks(xml.encode(), "p596", "IRS Pub. 596"))
    assert [(c["section_id"], c["parent_id"]) for c in made] == [("IRS Pub. 596: Intro", None), ("IRS Pub. 596: Intro [c]", "IRS Pub. 596: Intro"), ("IRS Pub. 596: Intro [d]", None), ("IRS Pub. 596: Intro [d]#2", None)]


def test_pages_sections_windows(spark):
    body = "This sentence is of middling length for a page. " * 4
    pages = {1: f"TITLE OF THE PAGE\n{body}\nWho must file:\n{body}\nsepa-\nrated", 2: "x", 3: None, 4: f"{body}\nPURPOSE OF IT\nDEFINITIONS\nLINE 3\n{body}", 5: "\n".join(f"Line {i}\n{body}" for i in range(1, 25))}
    df = spark.createDataFrame([(p, t) for p, t in pages.items()], "page int, t string")
    found = {r["page"]: r["s"] for r in df.select("page", text.page_sections("t", "page").alias("s")).collect()}
    assert [x["heading"] for x in found[1]] == ["Page 1", "Who must file:"] and found[1][0]["text"].startswith("TITLE") and found[1][1]["text"].endswith("separated")
    assert found[2] == [] and found[3] == [] and [x["heading"] for x in found[4]] == ["Page 4", "LINE 3"]
    assert len(found[5]) == 20 and len(df.where("page = 5").select(text.page_sections("t", "page", most=None).alias("s")).first()["s"]) == 24
    said = " ".join(f"Sentence number {i} is here." for i in range(100))
    cut = documents.windows(said, 300, 60)
    assert all(len(w) <= 300 + 60 for w in cut) and cut[0].split(". ")[-1].rstrip(".") in cut[1]
    assert {s.rstrip(".") for w in cut for s in w.split(". ")} == {s.rstrip(".") for s in said.split(". ")}
    assert documents.windows("short") == ["short"]
    rows = spark.createDataFrame([("p17", "p17.pdf", 1, f"{body}\n{body}"), ("p17", "p17.pdf", 2, None), ("p17", "p17.pdf", 3, "GENERAL NOTES:\n" + body * 30)], "source string, file string, page int, text string")
    chunks = documents.chunks_of_pages(rows, {"p17": "IRS Pub. 17"}).orderBy("place").collect()
    assert chunks[0]["section_id"] == "IRS Pub. 17: p001 s01 Page 1" and chunks[0]["metadata"]["window_index"] == 1
    names = [c["section_id"] for c in chunks[1:]]
    assert len(names) > 3 and names[:3] == ["IRS Pub. 17: p003 s01 Page 3", "IRS Pub. 17: p003 s01 Page 3 [p3]", "IRS Pub. 17: p003 s01 Page 3 [p3]#2"]
    assert chunks[0]["id"] == documents.short_hash("p17:p17.pdf:p1:s1:w1")


def test_order_depends_on_no_partition(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.xml").write_text(STATUTE.replace("stA/s1", f"stA/s1{name.upper()}"))
    plain = tmp_path / "plain"
    plain.mkdir()
    for i in range(7):
        (plain / f"section{i}").write_text(f"Text {i}")
    statute, files = documents.read_statute(spark, f"{tmp_path}/*.xml", 100), documents.read_plain(spark, str(plain))
    one = [(r["chunk_ord"], r["section_id"]) for r in documents.streams(statute, files).orderBy("chunk_ord").collect()]
    two = [(r["chunk_ord"], r["section_id"]) for r in documents.streams(statute.repartition(5), files.repartition(6)).orderBy("chunk_ord").collect()]
    assert one == two and [n for n, _ in one] == list(range(13)) and one[0][1] == "26 USC §1A" and one[6][1] == "SARA Source: 26 USC §0"


def test_readers(spark, tmp_path):
    (tmp_path / "usc.xml").write_text(STATUTE)
    chunks = documents.read_statute(spark, str(tmp_path / "usc.xml"), 100).orderBy("place").collect()
    assert [c["section_id"] for c in chunks] == ["26 USC §1", "26 USC §2(a)", "26 USC §2(b)"] and chunks[0]["cross_refs"] == ["26 USC §61(a)"]
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "section151").write_bytes(b"Allowance\nof \xff deductions")
    (plain / "other").write_text("\n§ 63 Taxable\nx")
    (plain / "blank").write_text(" \n")
    found = {r["section_id"]: r["cross_refs"] for r in documents.read_plain(spark, str(plain)).collect()}
    assert found == {"SARA Source: 26 USC §151": ["26 USC §151"], "SARA Source: 26 USC §63": ["26 USC §63"]}
    folder = tmp_path / "k" / "p17"
    folder.mkdir(parents=True)
    good = '<p><s id="a"><hd>H</hd><p>' + "w " * 60 + "</p></s></p>"
    (folder / "p17.xml").write_text(good)
    (tmp_path / "k" / "p596.xml").write_text("<broken")
    (tmp_path / "k" / "p17--2024.pdf").write_text("")
    (tmp_path / "k" / "i1040nr.xml").write_text(good)
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "k")).select("path")
    catalog = documents.discover(paths, ("i1040nr",))
    assert {(r["source"], r["format"], r["path"].rsplit("/", 1)[-1]) for r in catalog.collect()} == {("p17", "xml", "p17.xml"), ("p596", "xml", "p596.xml")}
    assert [r["section_id"] for r in documents.read_publications(spark, str(tmp_path / "k"), catalog, {"p17": "IRS Pub. 17"}).collect()] == ["IRS Pub. 17: H"]
    failed = documents.publication_errors(spark, str(tmp_path / "k"), catalog, {}).collect()
    assert [(r["source"], r["error"].split(":")[0]) for r in failed] == [("p596", "ParseError")]
    assert documents.source_key("P17--2024.pdf") == "p17" and documents.source_key("readme.pdf") is None


CASE = """% Text
% Alice was paid $100 in 2017.
% Question
% Section 151(d) applies to Alice. Entailment
% Facts
:- [statutes/prolog/init].
payment(alice).
% Test
goal :- \\+ s151(alice,_,100).
:- goal.
:- halt.
"""


def test_cases(spark, tmp_path):
    made = cases.parse_case("s151_d_pos", CASE)
    assert (made["question"], made["expected"], made["expected_type"], made["test_goal"], made["test_goal_negated"]) == ("Section 151(d) applies to Alice?", "Entailment", "label", "goal", True)
    money = cases.parse_case("tax_case_1", "% Question\n% How much tax does Bob owe? $1,200\n% Test\n:- tax(bob,2017,1200).\n:- halt.\n")
    assert (money["expected"], money["expected_type"], money["test_goal_numbers"]) == ("$1,200", "numeric", ["2017", "1200"])
    wrong = cases.parse_case("x", "% Question\n% How much? $5\n% Test\n:- tax(b,7).")
    assert wrong["expected"] == "7"
    assert cases.parse_case("y_neg", "% Question\n% It holds.\n% Test\n:- f(a).")["expected"] == "Contradiction"
    assert cases.signature("f(g(a,b),c)") == ("f", 2) and cases.signature("f") == ("f", 0) and cases.signature("+") is None
    assert cases.test_goal([]) == ("", False, []) and cases.test_goal([":- \\+ s1(a)."])[1] is True
    (tmp_path / "a.pl").write_text(CASE)
    (tmp_path / "b.pl").write_text(CASE)
    (tmp_path / "split").write_text("b\nmissing\n\na\n")
    rows = cases.read_cases(spark, str(tmp_path / "split"), str(tmp_path)).collect()
    assert [r["id"] for r in rows] == ["b", "a"] and rows[0]["relevant_ids"] == ["26 USC §151(d)"]
    assert [r["id"] for r in cases.read_cases(spark, str(tmp_path / "split"), str(tmp_path), 1).collect()] == ["b"]


def test_rubrics_references_and_results(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "1", "question": "q", "answer_rubric": "[+0.5] cites section 63"}\n\n{"id": "2", "question": "q2", "answer_rubric": null}\n')
    rows = cases.read_rubrics(spark, str(tmp_path / "r.jsonl")).orderBy("id").collect()
    assert [r["relevant_ids"] for r in rows] == [["26 USC §63"], []]
    spark.createDataFrame([("s", "f", "c", "q0", "a"), ("s", "f", "c", "q1", "b")], "source string, filename string, context string, question string, answer string").coalesce(1).write.parquet(str(tmp_path / "qa"))
    assert [(r["id"], r["question"]) for r in cases.read_references(spark, str(tmp_path / "qa"), 1).collect()] == [("irs_qa_0", "q0")]
    saved = [{"id": "a", "earned": 0.5}, {"id": "b", "earned": None}]
    assert cases.write_results(spark, str(tmp_path), "sara__x", "m", "hybrid", saved) and not cases.write_results(spark, str(tmp_path), "sara__x", "m", "hybrid", [])
    got = cases.read_results(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r["dataset"], r["model"], r["mode"], r["id"], r["earned"]) for r in got] == [("sara__x", "m", "hybrid", "a", 0.5), ("sara__x", "m", "hybrid", "b", None)]


def chunk_rows():
    long = "This is a sentence of some length about section 61 and Publication 17. " * 40
    at = datetime(2024, 1, 1)
    return [
        (0, "u", "26 USC §61", "usc26", "Gross income", "All income.", None, ["26 USC §1"], at),
        (1, "a", "IRS Pub. 596: Intro", "p596", "Intro", long, None, None, at),
        (2, "b", "IRS Pub. 17: Overview", "p17", "Overview", "See section 61.", None, [], at),
    ]


CHUNKS = "chunk_ord long, id string, section_id string, source string, title string, text string, parent_id string, cross_refs array<string>, ingested_at timestamp_ntz"


def test_pipeline_stages_and_cache(spark, tmp_path):
    chunks = spark.createDataFrame(chunk_rows(), CHUNKS)
    labels = {"p596": "IRS Pub. 596", "p17": "IRS Pub. 17"}
    parts = pipeline.split(pipeline.annotated(chunks, list(labels.values()))).orderBy("chunk_ord").collect()
    assert [p["id"] for p in parts] == ["u", "a_0", "a_1", "b"] and parts[0]["cross_refs"] == ["26 USC §1"] and parts[1]["cross_refs"] == ["26 USC §61", "IRS Pub. 17"]
    out = str(tmp_path / "built")
    first = pipeline.build(spark, chunks, labels, out, "v1")
    again = pipeline.build(spark, chunks, labels, out, "v1")
    changed = pipeline.build(spark, chunks, labels, out, "v2")
    assert first["n_chunks"] == 4 and first["audit"]["ok"] and not any(first["cache_hits"].values())
    assert all(again["cache_hits"].values()) and not any(changed["cache_hits"].values())
    edges, nodes = spark.read.parquet(f"{out}/edges.parquet"), spark.read.parquet(f"{out}/nodes.parquet")
    assert "IRS Pub. 17" in pipeline.graph_html(nodes, edges, 5)
    pipeline.graphml(nodes, edges, str(tmp_path / "g.graphml"))
    assert (tmp_path / "g.graphml").read_text().count("<edge ") == edges.count()
    html = pipeline.graph_html(nodes, edges, 5)
    assert html.count("<circle") == nodes.count() and html.count("<path") == edges.count()
    engine = Engine.open(spark, out)
    asked = spark.createDataFrame([(1, "What is gross income under section 61?"), (2, "overview")], "query_id long, text string")
    for mode in ("none", "vector", "graph", "hybrid"):
        hits = engine.retrieve(asked, mode, 3).collect()
        assert (mode == "none") is (not hits) and all(h["title"] is not None for h in hits)
    assert "26 USC §61" in {h["section_id"] for h in engine.retrieve(asked, "graph", 3).collect() if h["query_id"] == 1}
    assert engine.manifest["n_chunks"] == 4 and engine.community_of(nodes.where("source = 'usc26'")).count() == 1
    with pytest.raises(FileNotFoundError):
        Engine.open(spark, str(tmp_path / "nowhere"))
    (tmp_path / "built" / "build_cache.json").write_text("broken")
    assert not pipeline.Stages(spark, out).known


def test_generation_and_chat(spark):
    rows = spark.createDataFrame([("1", "s", "u", "rub"), ("2", "s", "boom", None)], "id string, system string, user string, rubric string")

    def model(system: str, user: str) -> str:
        if user == "boom":
            raise ValueError("no")
        return "yes"

    made = {r["id"]: r for r in generation.replies(rows, model).collect()}
    assert made["1"]["response"] == "yes" and made["2"]["response"] is None and made["2"]["error"].startswith("ValueError")
    verdicts = {r["id"]: r for r in generation.judged(spark.createDataFrame([("1", "x", "rub"), ("2", "x", None), ("3", "x", "bad")], "id string, response string, rubric string"), lambda s, u: "nope" if "bad" in u else json.dumps({"earned": 1, "total": 2, "feedback": "ok"})).collect()}
    assert (verdicts["1"]["earned"], verdicts["1"]["response"], verdicts["2"]["earned"], verdicts["3"]["judge_failed"]) == (1.0, "x", None, True)
    tried = []

    def slow(system, user):
        tried.append(1)
        if len(tried) < 3:
            raise TimeoutError
        return "late"

    assert generation.with_retries(slow)("", "") == "late" and len(tried) == 3
    chat = generation.Chat(lambda q, mode: f"context for {mode}")
    chat.say("hello")
    assert chat.say("/mode graph") == "mode graph" and len(chat.history) == 2 and set(chat.compare("x")) == {"none", "graph"}
    assert chat.say("/sources") == "context for hybrid" and "/sources" in chat.say("/help") and chat.say("/quit") == "bye"
    chat.say("/clear")
    assert chat.history == []
    scored = {r["id"]: r for r in generation.scored_answers(spark.createDataFrame([("1", "the levy is due", "[+1.0] The levy is due"), ("2", "x", None)], "id string, response string, rubric string"), lambda s, u: '{"earned": 1, "total": 1, "feedback": ""}').collect()}
    assert (scored["1"]["earned"], scored["1"]["rouge1"], scored["1"]["rougeL"], scored["2"]["earned"], scored["2"]["rouge1"]) == (1.0, 1.0, 1.0, None, None)


def test_results_are_saved_once(spark, tmp_path):
    made = lambda mode, earned: spark.createDataFrame([("d", "m1", mode, "c", earned, 1.0)], "dataset string, model string, mode string, case_id string, earned double, total double")
    path = str(tmp_path / "results")
    cases.save_results(made("graph", 0.5), path)
    cases.save_results(made("graph", 0.9).unionByName(made("none", 0.1)), path)
    read = lambda: {(r["mode"], r["earned"]) for r in spark.read.parquet(path).collect()}
    assert read() == {("graph", 0.5), ("none", 0.1)}
    cases.save_results(made("graph", 0.9), path, overwrite=True)
    assert read() == {("graph", 0.9), ("none", 0.1)}
    found = evaluation.filtered(spark.read.parquet(path), "d", "m")
    assert found.count() == 2 and evaluation.filtered(found, model="x").count() == 0
    assert pipeline.report(evaluation.mode_summary(found)).count("\n") == 2


def test_settings_and_profiles(spark, tmp_path):
    env = {"A": " Yes ", "B": "off", "N": "12", "X": "1.5"}
    assert config.flag("A", False, env) and not config.flag("B", True, env) and config.flag("C", True, env)
    assert (config.whole_number("N", 3, env), config.whole_number("X", 3, env), config.whole_number("Z", 3, env)) == (12, 3, 3)
    assert config.slug(" My Model: 2 ") == "my-model-2" and config.slug("!") == "default"
    root = tmp_path / "k"
    for name in ("2024-2026", "a", "z"):
        (root / name).mkdir(parents=True)
    assert config.profile_folder(spark, str(root)) == str(root)
    (root / "z" / "usc26.xml").write_text("x")
    assert config.profile_folder(spark, str(root)) == f"{root}/z"
    (root / "2024-2026" / "usc26.xml").write_text("x")
    assert config.profile_folder(spark, str(root)) == f"{root}/2024-2026" and config.profile_folder(spark, str(root), "a") == f"{root}/a"
    with pytest.raises(FileNotFoundError):
        config.profile_folder(spark, str(root), "none")


def test_streaming_state_matches_the_batch(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = chunk_rows()
    schema = spark.createDataFrame(rows, CHUNKS).schema
    for part in (rows[:1], rows[1:]):
        spark.createDataFrame(part, CHUNKS).coalesce(1).write.mode("append").parquet(source)
        refresh.keep_orphans(spark, spark.readStream.schema(schema).parquet(source), state, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert {r["key"] for r in refresh.current_orphans(spark, state).collect()} == {"26 USC §1"}
    more = str(tmp_path / "edges")
    spark.createDataFrame([(1, "26 USC §99", rows[0][-1]), (2, "26 USC §61", rows[0][-1])], "edge_id long, dst string, seen_at timestamp_ntz").write.parquet(more)
    arriving = spark.readStream.schema("edge_id long, dst string, seen_at timestamp_ntz").parquet(more)
    refresh.keep_orphans(spark, arriving, str(tmp_path / "of_edges"), str(tmp_path / "c3"), refresh.edge_deltas).awaitTermination(120)
    assert {r["key"] for r in refresh.current_orphans(spark, state, str(tmp_path / "of_edges")).collect()} == {"26 USC §1", "26 USC §99"}
    gone = refresh.edge_deltas(spark.read.parquet(more).withColumn("sign", F.lit(-1)))
    assert {r["key"] for r in orphans.orphan_keys(orphans.merged(refresh.edge_deltas(spark.read.parquet(more)), gone)).collect()} == set()
    retired = refresh.retired_deltas(spark.createDataFrame([("26 USC §99",)], "section_id string"))
    assert [tuple(r) for r in retired.select("key", "retired").collect()] == [("26 USC §99", 1)]
    counts = refresh.arrivals(spark.read.parquet(source)).collect()
    assert sum(r["n_chunks"] for r in counts) == 3
    stream = refresh.arrivals(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName("arrived").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert spark.table("arrived").agg(F.sum("n_chunks")).first()[0] == 3
