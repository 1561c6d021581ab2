"""Template residue and error pages."""

from __future__ import annotations

import random

import pytest

from corpuskiln.llm import residue as R

NOUNS = "levy wage ledger estate pension annuity gain award record basis".split()


def content(r: random.Random, n: int) -> str:
    forms = ("The {a} must equal the {b} shown in Publication 8483.", "Enter the {a} on line {n} of Form 7345 and keep the {b}.", "No {a} is allowed unless the lessee elects the {b}.", "Subtract $4,486 from the {a}, then multiply the {b} by {n} percent.")
    return " ".join(r.choice(forms).format(a=r.choice(NOUNS), b=r.choice(NOUNS), n=r.randrange(50)) for _ in range(n))


SPEAKS = (
    "The e-file portal asks a trustee to enable JavaScript before Form 7381 is signed online.", "A return rejected with code 404 lacks the levy; code 503 points to a wage.", "An error on line 3 does not void the estate.",
    'Write your name in the space marked "Name: ________" above the record.', "The set {1, 2, 3} in the table lists the levy and the [optional] attachment.", "A test case on the award is pending; more guidance is to come.", "Access to the record is denied to the trustee until May 3.",
)


@pytest.fixture(scope="module")
def scorer():
    r = random.Random(1)
    texts = [content(r, r.randrange(1, 8)) for _ in range(400)]
    texts += [f"{content(r, 3)} {s} {content(r, 2)}" for s in SPEAKS for _ in range(6)]
    texts += ["404 Not Found\nThe page you requested could not be located.", "Please enable JavaScript to view this page.", "Dear {{ client_name }}, your levy is due.", "To be written."] * 3
    return R.Scorer(R.fit(texts))


@pytest.mark.parametrize("text", [*SPEAKS, "", "   ", "Guarde los comprobantes de la pensión durante 17 meses."])
def test_content(scorer, text):
    r = random.Random(2)
    whole = f"{content(r, 2)} {text} {content(r, 1)}" if text.strip() else text
    assert scorer.kinds([whole]).tolist() == [0]


FIELDS = "{{ city }}|{{city}}|${due_date}|<%= balance %>|%(city)s|@@due_date@@|<<preparer>>|[[tax_year]]|__CLIENT_NAME__|%BALANCE%|#DUE_DATE#|##BALANCE##|{tax_year}|[INSERT city]|[Your balance]|[CLIENT NAME]|<city here>|(TODO: city)|XX/XX/XXXX|$X,XXX.XX"


@pytest.mark.parametrize("field", FIELDS.split("|"))
def test_fields(scorer, field):
    assert scorer.kinds([f"{content(random.Random(3), 4)} Our office at {field} will call you."]).tolist() == [1]


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Lorem ipsum dolor amet nulla porta morbi ornare ultra fusca velum lorem.", "filler"), ("Example of a levy\n[text]\nLimits on the wage\nComing soon.", "filler"), ("asdf qwer blah test 123 asdf", "filler"),
        ("404 Not Found\nThe page you requested could not be located.\n\nAll rights reserved.", "error_page"), ("500 Internal Server Error", "error_page"), ("Home | Forms | Contact\n\n503 Service Temporarily Unavailable\nRequest ID 45", "error_page"),
        ("Please enable JavaScript to view this page.", "script_notice"), ("You need to turn on scripting to continue.", "script_notice"), ("Skip to main content\n\nChecking your browser before access. Enable scripts and cookies.", "script_notice"),
    ],
)
def test_kinds(scorer, text, kind):
    assert R.KINDS[scorer.kinds([text])[0]] == kind


def test_dummy_text_amid_content(scorer):
    r = random.Random(5)
    dummy = "Lorem ipsum dolor amet nulla porta morbi ornare ultra fusca velum lorem magna aliqua."
    assert R.KINDS[scorer.kinds([f"{content(r, 4)}\n\n{dummy}\n\n{content(r, 3)}"])[0]] == "filler"


def test_fields_of_any_length_and_unseen_forms(scorer):
    r = random.Random(7)
    for field in ("{{ " + "client name and address " * 20 + "}}", "%(" + "city_" * 30 + ")s"):
        assert scorer.kinds([f"{content(r, 4)} Our office at {field} will call you."]).tolist() == [1]


def test_long_records_of_residue_are_trusted():
    text = "\n".join(["404 Not Found", "The page you requested could not be located."] * 40)
    assert R.Seeds().kind(text) == R.KINDS.index("error_page") and R.Seeds().kind(text + "\n" + content(random.Random(8), 2)) == -1


def test_judgement_needs_no_seed():
    """Records are judged by the model's scores: with no seeds asked at all, a fitted model finds what it found with them."""
    r = random.Random(1)
    texts = [content(r, r.randrange(1, 8)) for _ in range(300)] + ["404 Not Found\nThe page you requested could not be located.", "Dear {{ client_name }}, your levy is due.", "Dear @@client_name@@, your levy is due."] * 5
    scorer = R.Scorer(R.fit(texts))
    assert scorer.kinds(["404 Not Found", "Your levy, <client_name>, is due. Keep the wage.", content(r, 3)]).tolist() == [3, 1, 0]


def test_rare_forms_outside_the_sample_are_learned(spark):
    """Trusted forms come from the whole table, so the size of the unlabelled sample drops none."""
    r = random.Random(9)
    rows = [(i, content(r, 4)) for i in range(200)] + [(900, "Erreur 404 : page introuvable"), (901, "Session beendet. Fehler 503")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in R.residue(df, sample=40).collect()} == {(900, "error_page"), (901, "error_page")}


def test_tables(spark):
    r = random.Random(6)
    rows = [(i, content(r, 4), "x") for i in range(60)] + [(100, "404 Not Found", "x"), (100, "404 Not Found", "x"), (101, None, "x"), (102, " \n ", "x"), (103, content(r, 3000), "x"), (104, "Dear {{ name }}, see below.", "x"), (None, "404 Not Found", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert {tuple(x) for x in R.residue(df).collect()} == {(100, "error_page"), (104, "placeholder")}
    assert R.residue(df.where("false")).count() == 0
