"""References, text expressions, ROUGE and prompts with values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import prompts, refs, rouge, text

LABELS = ["IRS Pub. 596", "IRS Pub. 17", "Form 1040 Instructions", "Form 1040-ES Instructions", "Form 1099-Q Instructions", "Sch. C Instructions"]


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column).first()[0]


@pytest.mark.parametrize(
    "said, found",
    [
        ("section 401(k)(1) and § 61", ["26 USC §401(k)(1)", "26 USC §61"]),
        ("sections 61 are plural", []),
        ("section 12345", ["26 USC §1234"]),
        ("§25a and §25A", ["26 USC §25A", "26 USC §25a"]),
        ("section 151-153", ["26 USC §151", "26 USC §152", "26 USC §153"]),
        ("section 100–200", ["26 USC §100"]),
        ("§ 61(b)(2)", ["26 USC §61(b)(2)"]),
        ("", []),
        (None, []),
    ],
)
def test_usc_refs(value, said, found):
    assert value(refs.usc_refs(F.lit(said).cast("string"))) == found


def test_irs_refs_and_query_refs(value):
    assert value(refs.irs_refs(F.lit("Publication 596, pub 17, Form 1040-ES, Form 1040 and Sch. C; Form 9999"), LABELS)) == sorted(["IRS Pub. 596", "IRS Pub. 17", "Form 1040-ES Instructions", "Form 1040 Instructions", "Sch. C Instructions"])
    assert value(refs.irs_refs(F.lit("Schedule EIC"), LABELS)) == ["Form 1040 Instructions"]
    assert value(refs.query_irs_prefixes(F.lit("Schedule EIC and Pub. 17"))) == ["irs pub. 17", "irs pub. 596"]
    assert value(refs.query_section_refs(F.lit("§151(d)(1)"))) == ["26 usc §151", "26 usc §151(d)(1)"]
    assert value(refs.normal_key(F.lit("  Form  1040.  ES "))) == "form 1040 es"


def test_canonical_ids(value):
    for path, ref in (("/us/usc/t26/stA/ch1/s401/k/1", "26 USC §401(k)(1)"), ("/us/usc/t26/s25A", "26 USC §25A"), ("/us/usc/t26/stA", "/us/usc/t26/stA")):
        assert value(refs.canonical_id(F.lit(path))) == ref
    assert value(refs.usc_root(F.lit("26 USC §32(c)(2)"))) == "26 USC §32" and value(refs.usc_root(F.lit("IRS Pub. 17"))) is None
    assert value(refs.ancestor_refs(F.lit("26 USC §151(d)(1)"))) == ["26 usc §151(d)(1)", "26 usc §151", "26 usc §151(d)"]


@pytest.mark.parametrize(
    "a, b, score",
    [
        ("26 USC §151", "26 USC §151", 1.0), ("26 USC §151(d)", "26 USC §151", 0.75), ("26 USC §151", "26 USC §151(d)(1)", 0.5), ("26 USC §151(d)(1)", "26 USC §151(d)(2)", 0.25),
        ("26 USC §151(c)", "26 USC §151(d)", 0.0), ("26 USC §151", "26 USC §152", 0.0), ("26 USC  §151(d)", "26 USC §151 (d)", 0.5), ("IRS Pub. 17", "IRS Pub. 17", 1.0), ("IRS Pub. 17", "IRS Pub. 17: A", 0.0), ("", "26 USC §1", 0.0),
    ],
)
def test_match_scores_are_symmetric(value, a, b, score):
    assert value(refs.match_score(F.lit(a), F.lit(b))) == score == value(refs.match_score(F.lit(b), F.lit(a)))


def test_best_match_takes_the_first_of_equals(value):
    targets = F.array(F.lit("26 USC §1"), F.lit("26 USC §151(d)"), F.lit("26 USC §151(e)"))
    assert tuple(value(refs.best_match(F.lit("26 USC §151"), targets))) == (0.75, "26 USC §151(d)")
    assert tuple(value(refs.best_match(F.lit("26 USC §9"), targets))) == (0.0, None)


def test_sentences_windows_and_lines(value):
    assert value(text.sentences(F.lit(" One. Two! Three? four "))) == ["One.", "Two!", "Three?", "four"]
    assert value(text.sentences(F.lit(None).cast("string"))) == []
    assert value(text.packed_sentences(F.lit("Aaaa. Bbbb. Cccccccccccccccc. D."), 10)) == ["Aaaa. Bbbb.", "Cccccccccccccccc.", "D."]
    assert value(text.packed_sentences(F.lit("short"), 10)) == ["short"]
    assert value(text.slide_windows(F.lit("abcdefghij"), 4, 1)) == ["abcd", "defg", "ghij", "j"]
    assert value(text.page_lines(F.lit("a  b\n\nsepa-\nrate ­soft\r\n x"))) == ["a b", "separate soft", "x"]
    assert value(text.first_sentence(F.lit("One! Two."))) == "One!" and value(text.first_sentence(F.lit("x" * 200))) == "x" * 120


def test_headings_terms_and_titles(value):
    for line, is_head in (("Who must file", True), ("INCOME TAX", True), ("Keep this:", True), ("a plain line", False), ("ABC", False), ("X" * 111, False), ("", False)):
        assert value(text.is_heading(F.lit(line))) is is_head
    assert value(text.query_terms(F.lit("What is the EIC, and the eic limit?"))) == ["is", "eic", "eic", "limit"]
    assert sorted(value(text.topic_words(F.lit("The Earned income of earned")))) == ["earned", "income"]
    assert value(text.guessed_title(F.lit(" "), F.lit("One two. Three"), F.lit("L"), F.lit(3))) == "One two"
    assert value(text.guessed_title(F.lit(""), F.lit(""), F.lit("L"), F.lit(3))) == "L Page 3"
    assert value(text.shortened(F.lit("abcdefgh"), 6)) == "abc..."


def test_replies(value):
    assert value(text.final_answer(F.lit("x\nFinal Answer: $5 \nmore"))) == "$5" and value(text.final_answer(F.lit("none"))) is None
    for said, label in (("Final answer: yes", "entailment"), ("Final answer: not entailed", "contradiction"), ("It is contradictory", "contradiction"), ("not contradiction", "entailment"), ("entailment or unknown", "unknown"), ("yes", None)):
        assert value(text.predicted_label(F.lit(said))) == label
    assert value(text.numbers(F.lit("$1,200.50 then §151 far away from here 7, -5"))) == ["1200.50", "7", "5"]
    assert value(text.numbers(F.lit("section 63 and 8"))) == ["8"]
    assert value(text.rubric_total(F.lit("[+0.40] a [+0.30] b"))) == 0.7 and value(text.rubric_reference(F.lit("[+0.40] a [+1] b"))) == "a b"
    assert value(text.judge_reply(F.lit('```json\n{"earned": 1, "total": 2}\n```'))).asDict() == {"earned": 1.0, "total": 2.0, "feedback": "", "failed": False}
    for raw in ("no", "[1]", None, "{broken"):
        assert value(text.judge_reply(F.lit(raw).cast("string")))["failed"] is True
    assert value(text.is_numeric_question(F.lit("How much?"))) is True and value(text.is_numeric_question(F.lit("Why tax"))) is False


def test_rouge(value):
    for word, root in (("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("adjustment", "adjust"), ("happy", "happi"), ("probate", "probat"), ("controlling", "control")):
        assert rouge.stem(word) == root
    assert rouge.scores("the cat sat", "the cat sat") == (1.0, 1.0, 1.0) and rouge.scores("", "x") == (0.0, 0.0, 0.0)
    assert rouge.scores("a b c d", "a c b d") == (1.0, 0.0, 0.75)
    # taxes -> tax, filed and filing -> file
    assert tuple(value(rouge.rouge(F.lit("taxes filed late"), F.lit("tax filing")))) == (0.8, 0.6667, 0.8)


def test_prompts(value):
    assert value(prompts.label_options(F.lit("Is it unknown?"))) == ["Entailment", "Contradiction", "Unknown"]
    made = value(prompts.case_prompt(F.lit("Q?"), F.lit(""), F.lit("f(x)."), F.lit("label"), F.array(F.lit("26 USC §1"))))
    assert "(none)" in made and "exactly one of: Entailment, Contradiction." in made and "26 USC §1" in made
    assert "excerpts" not in value(prompts.system_prompt(F.lit("")))
