"""Defects of question-answer pairs."""

from __future__ import annotations

import pytest

from corpuskiln.llm import pairs as P

Q = "When must the deferred wage be sent to the agency?"
SOUND = [
    "By March 10", "The deferred wage must be sent by March 15 of the following year.", "No", "0", "It does not change it.", "Only if the levy changes by more than 37 percent",
    "I can't think of a case where the wage alone would force it.", "The agency is unable to process the form, and it is returned.", "A signed wage, bank slips, a dated log, etc.",
    "1. Find the wage. 2. Reduce it by $5. 3. Copy the result to line 3.", 'Keep the form known as "Constancia de gastos".', "No. You cannot claim the deferred wage.",
    "The wage is reduced; sorry cases are reviewed on request.", "Enter it on line 3 (see the worksheet), then stop",
]
BROKEN = [
    (None, "empty"), ("", "empty"), (" \n\t", "empty"), ("​ ", "empty"), ("--", "empty"), ("?", "empty"), ("Answer:", "empty"), ("N/A", "empty"), ("[no answer]", "empty"), ("(blank)", "empty"), ("TBD", "empty"), ("nan", "empty"),
    ("The wage is reduced by the [...]", "truncated"), ("Enter it on line 3 (see the", "truncated"), ("1. Find the wage. 2. Reduce it by $5. 3.", "truncated"), ("The wage is lost, and the wage…", "truncated"), ("Run ```\ncode", "truncated"), ('He said "keep the wage', "truncated"), ("The <b>wage is due", "truncated"), ("The wage, the levy,", "truncated"),
    ("This is not something I can answer. Try asking something else.", "refusal"), ("I'm sorry, but I do not have access to that kind of information and cannot respond.", "refusal"), ("That falls outside what this assistant may cover.", "refusal"), ("Regrettably, I must decline to discuss the wage.", "refusal"), ("Per my guidelines, no answer can be offered here about the wage.", "refusal"),
    ("When must the deferred wage be sent to the agency", "copied"), ("You asked: When must that deferred wage be sent to the agency?", "copied"), ("  WHEN MUST THE DEFERRED WAGE BE SENT TO THE AGENCY?", "copied"), ("When must the wage be sent to the agency?", "copied"),
    ("Guarde los comprobantes de la pensión durante 17 meses.", "language"), ("Обычно работодатель не может включать субсидию.", "language"), ("Answer: Bewahren Sie die Belege für die Umzugskosten mindestens 16 Monate auf.", "language"), ("请将递延扣除额的凭证保存36个月。", "language"), ("Hãy giữ giấy tờ về khoản khấu trừ hoãn lại trong 32 tháng.", "language"),
]


def words_of(texts):
    return P.Words({w: tuple(c) for w, c in P.word_counts(texts).items()})


@pytest.fixture(scope="module")
def model():
    return words_of(SOUND)


@pytest.mark.parametrize("answer", SOUND)
def test_sound_answers(model, answer):
    assert P.defect(Q, answer, model) is None


@pytest.mark.parametrize("answer, kind", BROKEN)
def test_broken_answers(model, answer, kind):
    assert P.defect(Q, answer, model) == kind


def test_languages_follow_the_question(model):
    asked = "¿Cómo se informa el total de $89,668 en Form 7326 para 2025?"
    assert P.defect(asked, "Guarde los comprobantes de la pensión durante 17 meses.", model) is None
    assert P.defect(asked, "A household employer defers the wage at the start of the term if it exceeds $5.", model) == "language"


def test_phrases_and_words_that_break_off():
    m = words_of([f"The {a} levy is reduced by {n} percent of the {a} wage. Keep {n} copies of the {a} levy for the agency." for n in range(40) for a in ("joint", "rural", "shared")])
    for open_end in ("The joint levy is reduced by", "Keep 3 copies of the rural levy for the age", "Keep the joint", "The levy is", "Keep the wage and", "The wage is due, unless the agency", "Keep $"):
        assert P.is_truncated(open_end, m), open_end
    for whole in ("The joint levy is reduced by 3 percent of the joint wage", "By March 10", "On line 4a of Form 7390-EX", "Only if the levy falls", "The joint levy", "Yes, once"):
        assert not P.is_truncated(whole, m), whole
    assert not P.is_truncated("anything at all", words_of([]))


def test_words_that_answers_end_with_are_complete():
    m = words_of(["Yes, once", "Yes, once", "Yes, once", "It is due once the levy ends."])
    assert not P.is_truncated("Yes, once", m)


def test_repeated_question_is_a_copy_and_long_fields_count(model):
    assert P.defect(Q, " ".join([Q] * 6), model) == "copied" and P.defect(Q, " ".join([Q] * 400), model) == "copied"
    assert P.language("“" + "Guarde los comprobantes de la pensión durante este año. " * 20 + "” is what the form says, and it is the only one.")[0] == "en"


def test_grammar_parses_from_any_token():
    g = P.Grammar({"S": ("WHO can not? ~2 ACT",), "WHO": ("i", "the model"), "ACT": ("help", "weigh in")})
    for said in ("so i can not help", "the model can weigh in", "i can not really ever help"):
        assert g.found("S", said.split()), said
    for said in ("i can not . help", "the can help", "i can a b c help"):
        assert not g.found("S", said.split()), said


@pytest.mark.parametrize("lexicon", [1, 7, 60])
def test_words_beyond_the_broadcast_ones_count(spark, lexicon):
    texts = [f"The {a} levy is reduced by {n} percent of the {a} wage. Keep {n} copies of the {a} levy for the agency." for n in range(12) for a in ("joint", "rural", "shared")]
    texts += ["Keep the joint", "Keep 3 copies of the rural levy for the age", "The wage is due, unless the agency", "The levy for the agency", "Keep the wag", "Yes"]
    df = spark.createDataFrame([(i, "What about it?", t) for i, t in enumerate(texts)], "qa_id long, question string, answer string")
    want, got = ({tuple(r) for r in P.defective_pairs(df, **k).collect()} for k in ({}, {"lexicon": lexicon}))
    assert got == want and {i for i, _ in want} == {36, 37, 38, 40}


def test_parser_and_tiles():
    assert P.left_open("a (b [c]) \"d\" `e` <b>f</b>") == [] and P.left_open("x ((y)") == ["("] and P.left_open("a) b]") == []
    assert P.left_open("1. one 2. two on line 22.") == [] and P.left_open("```a (```") == []
    assert P.tiles("a b c x y".split(), "x y z a b c".split()) == [(0, 3, 3), (3, 0, 2)]


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, Q, "", "s", 0), (1, Q, "", "s", 0), (2, None, "By May 3", None, 1), (3, Q, None, None, 1), (None, Q, "", None, 1), (4, Q, "word " * 60_000 + "end.", "s", 1), (5, Q, "B", "s", 1), (5, Q, "", "s", 1)]
    df = spark.createDataFrame(rows, "qa_id long, question string, answer string, defect string, _q int")
    assert {tuple(r) for r in P.defective_pairs(df).collect()} == {(1, "empty"), (3, "empty"), (5, "empty")}
    assert P.defective_pairs(df.where("false")).count() == 0
