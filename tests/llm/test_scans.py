"""Repair of scanned pages."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from corpuskiln.llm import scans as S

CLEAN = [
    "Enter the penalty on line 3 of the form and keep the modified ledger within 60 days of receipt.",
    "The reportable distribution is treated as a long-term gratuity while the appeal is pending.",
    "A household employer keeps copies of the annuity as the property was mixed use.",
    "Self-employed filers – but not both spouses – use the year-end total from box 1a.",
    "The instructions of the publication name the withholding and the residual interest.",
] * 30


@pytest.fixture(scope="module")
def channel():
    words, pairs = Counter(), Counter()
    for t in CLEAN:
        found = S.tokens(t)
        words.update(found)
        pairs.update(zip(("", *found), found))
    h = S._Hashes()
    keys = np.array([S.pair_hashes(np.array([h[a]], np.uint64), np.array([h[b]], np.uint64))[0] for a, b in pairs])
    order = np.argsort(keys)
    return S.Channel(dict(words), (keys[order], np.array(list(pairs.values()))[order]))


def work(channel, text, label="IRS Pub. 8483", first=16, last=17):
    return S.clean(text, label, first, last, channel)


@pytest.mark.parametrize(
    "text, clean",
    [
        ("Enter the pena|ty on line 3.", "Enter the penalty on line 3."),
        ("Keep the perialty and the modiﬁed ledger.", "Keep the penalty and the modified ledger."),
        ("The residiial grãtuity within 60 days.", "The residual gratuity within 60 days."),
        ("A househo|d emp1oyer keeps the annui+y.", "A household employer keeps the annuity."),
        ("THE WITHHOLDlNG", "THE WITHHOLDING"),
    ],
)
def test_misread_words(channel, text, clean):
    assert work(channel, text) == (clean, ["misread"])


@pytest.mark.parametrize("text, kind", [("keep the distri-\nbution now", True), ("keep the distri¬\nbution now", True), ("keep the distri­\nbution now", True), ("keep the distri- bution now", True), ("short- and long-term", False), ("Form 7390-\nEX and line", False), ("filers – but not both", False)])
def test_hyphenation(channel, text, kind):
    got, noise = work(channel, text)
    assert ("hyphenation" in noise) is kind
    if kind:
        assert got == "keep the distribution now"


def test_a_compound_divided_at_its_hyphen_keeps_it(channel):
    assert work(channel, "a long-\nterm gratuity") == ("a long-term gratuity", ["hyphenation"])
    assert work(channel, "a long-term gratuity and year-end total") == ("a long-term gratuity and year-end total", [])


@pytest.mark.parametrize("line, found", [("16", True), ("17.", True), ("- 16 -", True), ("— 16 —", True), ("[16]", True), ("Page 16", True), ("Pg. 16", True), ("P a g e  16", True), ("page 16 of 59", True), ("45", False), ("2. Divide it by 16.", False), ("16 copies", False)])
def test_page_numbers(channel, line, found):
    got, noise = work(channel, f"Enter the penalty on line 3 of the form.\n{line}\nKeep the ledger.")
    assert ("page_number" in noise) is found and (line in got) is not found


def test_a_wrapped_number_is_no_page_number(channel):
    assert work(channel, "Keep the ledger and the form on line\n16.")[1] == []
    assert work(channel, "Keep the ledger and the form.\n16.")[1] == ["page_number"]


@pytest.mark.parametrize(
    "line, kinds",
    [
        ("IRS Pub. 8483 (2016)", ["running_header"]), ("IRS PUB. 8483 • TAX YEAR 2020   16", ["page_number", "running_header"]), ("Page 17    irs pub. 8483 -- cat. no. 50313k", ["page_number", "running_header"]),
        ("2018 Instructions, continued | IRS Pub. 8483", ["running_header"]), ("Department Copy     IRS Pub. 8483", ["running_header"]), ("Chapter 3   Separate loss", ["running_header"]),
        ("See page 16 of IRS Pub. 8483 (2016) for the ledger", []), ("IRS Pub. 8483 has the form", []), ("KEEP THE LEDGER AND THE FORM.", []),
    ],
)
def test_running_headers(channel, line, kinds):
    assert work(channel, f"Enter the penalty on\n{line}\nline 3 of the form.")[1] == kinds


def test_no_length_limits(channel):
    assert S.clean("Enter the penalty on line 3 of the form.\nPage 123456\nKeep the ledger.", "IRS Pub. 8483", 123455, 123457, channel)[1] == ["page_number"]
    assert work(channel, f"Enter the penalty on\nChapter 1234   {' '.join(['penalty'] * 30)}\nline 3 of the form.")[1] == ["running_header"]


def test_context_decides_between_two_true_words():
    words = Counter({"the": 400, "cast": 100, "east": 100, "exam": 90, "leaves": 90})
    pairs = Counter({("cast", "exam"): 90, ("east", "leaves"): 90})
    h = S._Hashes()
    keys = np.array([S.pair_hashes(np.array([h[a]], np.uint64), np.array([h[b]], np.uint64))[0] for a, b in pairs])
    order = np.argsort(keys)
    both = S.Channel(dict(words), (keys[order], np.array(list(pairs.values()))[order]))
    assert both.decode(["east", "exam"]) == ["cast", "exam"] and both.decode(["east", "leaves"]) == ["east", "leaves"] and both.decode(["the", "east"]) == ["the", "east"]


def test_paragraphs_stay_apart(channel):
    assert work(channel, "The form\nof receipt.\n\nKeep the\r\nledger.") == ("The form of receipt.\n\nKeep the ledger.", [])


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    base = [(f"c{i}", "IRS Pub. 8483: x", "p8483", t, None, None, 1, 0) for i, t in enumerate(CLEAN)]
    dirty = [("d", "IRS Pub. 8483: x", "p8483", "Enter the pena|ty\nPage 3", 3, 3, 1, 0), ("d", "IRS Pub. 8483: x", "p8483", "old\nPage 3", 3, 3, 0, 0), ("e", None, None, None, 3, 3, 1, 0), ("f", None, None, " ", 3, None, 1, 0), ("g", None, None, "Keep the ledger.\nPage 4", None, 4, None, 0), (None, "x", "p", "x", 1, 1, 1, 0)]
    df = spark.createDataFrame(base + dirty, "id string, section_id string, source string, text string, page_start int, page_end int, ingested_at int, noise int").repartition(3)
    assert {tuple(r) for r in S.noise(df).collect()} == {("d", "misread"), ("d", "page_number"), ("g", "page_number")}
    assert {r["id"]: r["text"] for r in S.repaired(df).collect()} == {"d": "Enter the penalty", "f": "", "g": "Keep the ledger."}
    assert S.noise(df.where("false")).count() == 0
    words, pairs = S.statistics(df.select("text").where("text is not null"))
    assert {r["word"]: r["n"] for r in words.collect()}["penalty"] == 30
    h = S._Hashes()
    of = lambda a, b: int(S.pair_hashes(np.array([h[a]], np.uint64), np.array([h[b]], np.uint64))[0])
    counts = {r["pair"]: r["n"] for r in pairs.collect()}
    assert counts[of("modified", "ledger")] == 30 and counts[of("the", "penalty")] == 30 and of("ledger", "modified") not in counts


@pytest.mark.parametrize("lexicon, bigrams", [(1, S.BIGRAMS), (12, 3), (40, 20), (S.LEXICON, 1)])
def test_words_and_pairs_beyond_the_broadcast_ones_count(spark, lexicon, bigrams):
    texts = [*CLEAN, "Enter the pena|ty and the residiial inter-\nest due.", "the with-\nholding and the perialty", "a long-\nterm house-\nhold's year-\nend", "a well-known\nfili- ers' an- d'co-\npies"]
    rows = [(f"c{i}", "IRS Pub. 1: a", 3, 3, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, section_id string, page_start int, page_end int, text string, ingested_at int")
    want, got = ({r["id"]: (r["text"], r["noise"]) for r in S.repaired(df, *n).collect()} for n in ((), (lexicon, bigrams)))
    assert got == want
    assert got["c150"] == ("Enter the penalty and the residual interest due.", ["hyphenation", "misread"])
