"""Text expressions: sentences, windows, page lines, headings, titles, labels, numbers and judge replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strings() -> Column:
    return F.array().cast("array<string>")


def strip(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def sentences(text: Column | str) -> Column:
    """Sentences: split after . ! ? with white space, stripped, without empty ones; null gives none."""
    parts = F.transform(F.split(F.coalesce(_col(text), F.lit("")), r"(?U)(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda s: s != "")


def first_sentence(text: Column | str) -> Column:
    """Up to the first . ! or ?, else the first 120 characters."""
    t = F.coalesce(_col(text), F.lit(""))
    head = F.regexp_extract(t, r"(?s)^(.*?[.!?])", 1)
    return strip(F.when(head != "", head).otherwise(F.substring(t, 1, 120)))


def packed_sentences(text: Column | str, limit: int = 2000) -> Column:
    """Sentences packed greedily into parts of at most `limit` characters (joining spaces uncounted; a longer sentence stays whole).

    A text within the limit is one part, unchanged.
    """
    t = _col(text)
    start = F.struct(_strings().alias("parts"), _strings().alias("open"), F.lit(0).alias("n"))

    def add(state: Column, s: Column) -> Column:
        full = (state["n"] + F.length(s) > limit) & (F.size(state["open"]) > 0)
        return F.when(full, F.struct(F.array_append(state["parts"], F.array_join(state["open"], " ")).alias("parts"), F.array(s).alias("open"), F.length(s).alias("n"))).otherwise(
            F.struct(state["parts"].alias("parts"), F.array_append(state["open"], s).alias("open"), (state["n"] + F.length(s)).alias("n"))
        )

    def close(state: Column) -> Column:
        return F.when(F.size(state["open"]) > 0, F.array_append(state["parts"], F.array_join(state["open"], " "))).otherwise(state["parts"])

    return F.when(F.length(t) <= limit, F.array(t)).otherwise(F.aggregate(sentences(t), start, add, close))


def slide_windows(text: Column | str, size: int, overlap: int) -> Column:
    """Windows of `size` characters that overlap, stripped, without empty ones."""
    t = F.coalesce(_col(text), F.lit(""))
    step = max(1, size - overlap)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)), F.lit(step)), lambda i: strip(t.substr(i, F.lit(size))))
    return F.filter(cut, lambda w: w != "")


def page_lines(text: Column | str) -> Column:
    """Lines of a page: soft hyphens dropped, words divided by "-" at a line end joined, white space collapsed, blank lines dropped."""
    t = F.replace(F.coalesce(_col(text), F.lit("")), F.lit("\u00ad"), F.lit(""))
    t = F.regexp_replace(t, r"(?U)-\s*\n\s*", "")
    lines = F.transform(F.split(t, r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]"), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.filter(lines, lambda x: x != "")


#: How a heading may begin (fixed value).
HEADING_START = r"^(?:part\s+[ivxlcdm0-9]+|chapter\s+\d+|section\s+\d+|line\s+\d+|general instructions|specific instructions|worksheet|purpose of|who must|what'?s new|definitions|exceptions?)\b"


def is_heading(line: Column | str) -> Column:
    """At most 110 characters, and ending in a colon, of six or more letters that are 85 % capitals, or beginning like a heading."""
    x = F.coalesce(_col(line), F.lit(""))
    letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))
    starts = x.rlike("(?iU)" + HEADING_START)
    return (F.length(x) > 0) & (F.length(x) <= 110) & (x.endswith(":") | starts | ((letters >= 6) & (capitals >= letters * 0.85)))


def page_sections(text: Column | str, page: Column | str, least: int = 120, most: int | None = 20) -> Column:
    """array<struct<heading, text>> of a page: its first `most` sections (None: all).

    A heading begins a section if there is text since the last one began, else
    it is text. Sections of fewer than `least` characters are left out; if none
    is left, the page is one section under its last heading, if long enough.

    The lines' kinds are a string of letters, in which a run of headings is
    paired off: every second one begins a section.
    """
    lines = page_lines(text)
    kinds = F.array_join(F.transform(lines, lambda x: F.when(is_heading(x), F.lit("h")).otherwise(F.lit("t"))), "")
    marks = F.replace(F.replace(F.regexp_replace(kinds, "^h", "t"), F.lit("hh"), F.lit("st")), F.lit("h"), F.lit("s"))
    # \x01 begins a section and \x02 ends its heading.
    marked = F.transform(lines, lambda x, i: F.when(marks.substr(i + 1, F.lit(1)) == "s", F.concat(F.lit("\x01"), F.substring(x, 1, 120), F.lit("\x02"))).otherwise(F.concat(x, F.lit("\n"))))
    first = F.concat(F.lit("Page "), (F.col(page) if isinstance(page, str) else page).cast("string"))
    groups = F.transform(
        F.split(F.array_join(marked, ""), "\x01"),
        lambda g, i: F.struct(
            F.when(i == 0, first).otherwise(F.substring_index(g, "\x02", 1)).alias("heading"),
            F.replace(F.rtrim(F.replace(F.substring_index(g, "\x02", -1), F.lit("\n"), F.lit(" "))), F.lit("\n"), F.lit(" ")).alias("text"),
        ),
    )
    kept = F.filter(groups, lambda g: F.length(g["text"]) >= least)
    if most is not None:
        kept = F.slice(kept, 1, most)
    whole = F.array_join(lines, " ")
    spare = F.when(F.length(whole) >= least, F.array(F.struct(F.element_at(groups, -1)["heading"].alias("heading"), whole.alias("text"))))
    return F.when(F.size(kept) > 0, kept).otherwise(F.coalesce(spare, F.array().cast("array<struct<heading:string,text:string>>")))


def topic_words(text: Column | str, least: int = 4) -> Column:
    """Distinct lower-case runs of `least` or more ASCII letters."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(rf"([a-zA-Z]{{{least},}})"), 1)
    return F.array_distinct(F.transform(found, F.lower))


#: Words that a query isn't searched for (fixed values).
STOP_WORDS = (
    "about", "after", "also", "and", "any", "are", "can", "for", "from", "how", "into", "its", "like", "line", "lines", "more", "that", "the",
    "their", "them", "then", "there", "these", "this", "those", "what", "when", "where", "which", "with", "would", "your",
)


def query_terms(text: Column | str) -> Column:
    """Lower-case words of two or more ASCII letters or digits without stop words; repeats kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(r"(?U)\b([a-z0-9]{2,})\b"), 1)
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def shortened(text: Column | str, length: int) -> Column:
    """At most `length` characters, a cut marked by "..."."""
    t = _col(text)
    return F.when(F.length(t) <= length, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, max(0, length - 3))), F.lit("...")))


def guessed_title(heading: Column, text: Column, label: Column, page: Column) -> Column:
    """The heading in 96 characters, else the first 14 words of the first sentence, else "label Page n"."""
    words = F.split(F.regexp_replace(strip(F.substring_index(F.coalesce(text, F.lit("")), ".", 1)), r"(?U)\s+", " "), " ")
    first = F.substring(F.array_join(F.slice(words, 1, 14), " "), 1, 96)
    page_title = F.concat(label, F.lit(" Page "), page.cast("string"))
    return F.coalesce(F.nullif(F.substring(strip(F.coalesce(heading, F.lit(""))), 1, 96), F.lit("")), F.nullif(first, F.lit("")), page_title)


# --- replies --------------------------------------------------------------


def normal_string(text: Column | str) -> Column:
    """Lower case, everything but a-z, 0-9 and white space as spaces, collapsed."""
    t = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"(?U)[^a-z0-9\s]", " ")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def final_answer(response: Column | str) -> Column:
    """What follows the first "final answer:" on its line; null if nothing does."""
    r = F.coalesce(_col(response), F.lit(""))
    return F.nullif(strip(F.regexp_extract(r, r"(?im)final\s+answer\s*:\s*(.+)$", 1)), F.lit(""))


def canonical_label(text: Column | str, booleans: bool = False) -> Column:
    """unknown, contradiction or entailment as a text says it, negated forms first; null if it doesn't."""
    t = normal_string(text)
    chain = (
        F.when(t.rlike(r"\b(?:unknown|indeterminate|cannot determine|insufficient information)\b"), F.lit("unknown"))
        .when(t.rlike(r"\b(?:not entailment|not entailed|does not entail)\b"), F.lit("contradiction"))
        .when(t.rlike(r"\b(?:not contradiction|not contradictory)\b"), F.lit("entailment"))
        .when(t.rlike(r"\b(?:contradiction|contradictory|contradicts|contradict)\b"), F.lit("contradiction"))
        .when(t.rlike(r"\b(?:entailment|entailed|entails)\b"), F.lit("entailment"))
    )
    if booleans:
        chain = chain.when(t.rlike(r"^(?:true|yes)(?: |$)"), F.lit("entailment")).when(t.rlike(r"^(?:false|no)(?: |$)"), F.lit("contradiction"))
    return chain


def predicted_label(response: Column | str) -> Column:
    """The label of the final answer, else of the whole reply."""
    return F.coalesce(canonical_label(final_answer(response), booleans=True), canonical_label(response))


def is_numeric_question(question: Column | str) -> Column:
    q = F.lower(F.coalesce(_col(question), F.lit("")))
    asked = q.contains("?") & (q.contains("tax") | q.contains("amount"))
    return q.contains("how much") | q.contains("$") | asked


def numbers(text: Column | str) -> Column:
    """All numbers of a text without $ and commas; not those that a § within 16 characters or the word "section" precedes.

    The matches' offsets are those of the parts between them, so the look-back is
    the end of the text before each match.
    """
    t = F.coalesce(_col(text), F.lit(""))
    pattern = r"(-?\$?\s*[0-9][0-9,]*(?:\.[0-9]+)?)"
    found = F.regexp_extract_all(t, F.lit(pattern), 1)
    between = F.split(t, pattern)

    def walk(state: Column, i: Column) -> Column:
        before = F.concat(state["text"], F.get(between, i))
        back = F.lower(F.when(F.length(before) > 16, F.right(before, F.lit(16))).otherwise(before))
        cited = back.contains("§") | F.rtrim(back).endswith("section")
        value = F.regexp_replace(F.get(found, i), r"[-$,\s]", "")
        return F.struct(
            F.concat(before, F.get(found, i)).alias("text"),
            F.when(cited, state["kept"]).otherwise(F.array_append(state["kept"], value)).alias("kept"),
        )

    start = F.struct(F.lit("").alias("text"), _strings().alias("kept"))
    places = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, walk, lambda s: s["kept"])


def rubric_total(rubric: Column | str) -> Column:
    """The sum of a rubric's [+0.40] marks; 0 without any."""
    marks = F.regexp_extract_all(F.coalesce(_col(rubric), F.lit("")), F.lit(r"\[\+([0-9]+(?:\.[0-9]+)?)\]"), 1)
    return F.round(F.aggregate(F.transform(marks, lambda m: m.cast("double")), F.lit(0.0), lambda a, m: a + m), 4)


def rubric_reference(rubric: Column | str) -> Column:
    """A rubric without its marks."""
    return strip(F.regexp_replace(F.coalesce(_col(rubric), F.lit("")), r"\[\+[0-9]+(?:\.[0-9]+)?\]\s*", ""))


def judge_reply(raw: Column | str) -> Column:
    """struct(earned, total, feedback, failed) of a judge's JSON reply, with or without a code fence; nulls where it can't be read."""
    body = strip(F.regexp_replace(F.coalesce(_col(raw), F.lit("")), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    parsed = F.from_json(body, "earned double, total double, feedback string")
    is_object = body.startswith("{") & body.endswith("}") & parsed.isNotNull()
    return F.struct(
        F.when(is_object, F.coalesce(parsed["earned"], F.lit(0.0))).alias("earned"),
        F.when(is_object, F.coalesce(parsed["total"], F.lit(0.0))).alias("total"),
        F.when(is_object, F.coalesce(parsed["feedback"], F.lit(""))).alias("feedback"),
        (~F.coalesce(is_object, F.lit(False))).alias("failed"),
    )


def prompt(hits: Column) -> Column:
    """"[section_id]\\ntext" of each hit struct, separated by rules; the snippet where there is no text."""
    return F.array_join(F.transform(hits, lambda h: F.concat(F.lit("["), h["section_id"], F.lit("]\n"), F.coalesce(h["text"], F.lit("")))), "\n\n---\n\n")
