"""Template residue, filler, error pages and script notices, by positive-unlabelled naive Bayes.

A text is cut into passages: lines and sentences, and each marked span (what
stands in brackets or between signs) is a passage of its own. A naive Bayes
model over words, and over signs, shape and words of spans, has five classes:
content and the four kinds. It is learned by expectation-maximization from
trusted passages and from unlabelled ones, whose class is estimated anew each
round. Trusted are records in which seed phrases mark every passage of any
length, spans of seed forms, and a few examples of each kind; all these only label what the
model is learned from. Every passage of every record is then scored, and
scores alone decide:

* placeholder: a span is scored as a field;
* filler: a passage of dummy text has `least` words or more, or such passages make up a quarter beside headings;
* error_page, script_notice: such passages outweigh the content.

The model is fitted on at most `sample` trusted records and spans, one for each
form that they take anywhere in the table (digits and case aside), and `sample`
unlabelled records, both chosen by hash where there are more: bounds that don't grow with the data.

Null and blank texts give no row; repeated ids one row (the least kind). In an
empty table nothing is found. Foreign and unknown words weigh for no class.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions.words import split_words
from corpuskiln.session import durable

KINDS = ("content", "placeholder", "filler", "error_page", "script_notice")
SAMPLE = 10_000
ROUNDS = 6
LEAST = 8
MASS = 1000.0

#: What may be a field: text in brackets or between signs, and masks of the letter X.
SPAN = re.compile(
    r"\{\{[^{}\n]*\}\}|\{%[^{}\n]*%\}|\$?\{[^{}\n]*\}|<<[^<>\n]*>>|<[^<>\n]*>|\[\[[^\[\]\n]*\]\]|\[[^\[\]\n]*\]|%\([^()\n]*\)[a-z]|\([^()\n]*\)"
    r"|@@\w+@@|__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__|%[A-Za-z]\w*%|#+[A-Za-z]\w*#+|\$?\bX[X,]*X(?:\.XX)?\b(?:[/-]X+)*|\b[a-z]{2}/[a-z]{2}/[a-z]{4}\b"
)
#: Signs without which (and without round brackets) a text has no span.
_SIGNS = ("{", "<", "[", "@@", "__", "%", "#", "XX", "X,", "/")
#: Ends of sentences and lines; it begins with the blank, so that a search skips from blank to blank.
_PASSAGES = re.compile(r"\s(?:(?<=[.!?。！？]\s)|(?<=\n))\s*")

#: Forms of spans and phrases of messages that are trusted (fixed values).
SEEDS: dict[str, tuple[str, ...]] = {
    "placeholder": (r"\{\{.*\}\}", r"\$\{.*\}", r"<%.*%>", r"#{1,2}[A-Z][A-Z0-9_]+#{1,2}", r"\[(?:INSERT|ENTER) .+\]", r"\$X[X,]+(?:\.XX)?", r"XX/XX/XX(?:XX)?"),
    "filler": (
        r"\blorem ipsum\b", r"\bdolor (?:sit )?amet\b", r"\b(?:asdf|qwer(?:ty)?) ", r"\bto be written\b", r"\bcoming soon\b", r"\bcontent pending\b", r"^\[text\]$", r"^\(copy\)$", r"\bx{4,} x{4,}", r"\bTK TK\b", r"\bplaceholder (?:paragraph|text)\b", r"\b(?:test ){3,}",
        r"\bdummy (?:paragraph|text)\b", r"\b(?:before|prior to) publish", r"\btext to follow\b", r"\byour (?:content|text) here\b", r"\btext goes here\b", r"\bdrafted by\b.{0,20}\beditors\b",
    ),
    "error_page": (
        r"^(?:error )?(?:4\d\d|5\d\d)\b.{0,40}(?:not found|denied|forbidden|unauthori[sz]ed|unavailable|error|gateway|timeout|timed out)", r"\binternal server error\b", r"\bbad gateway\b", r"\bservice (?:temporarily )?unavailable\b", r"\btoo many requests\b", r"\bpage (?:you (?:requested|are looking for)|not found)\b",
        r"\btraceback \(most recent", r"\bfatal error: uncaught", r"\berror establishing a database", r"\bsession has expired\b", r"\bno longer available\b", r"\bsomething went wrong\b", r"\bcouldn.t find that page", r"\b\w+\.\w+\.\w*exception: ", r"\bcould not be opened \(code", r"\bscheduled maintenance\b",
        r"\bp[aá]gina no encontrada\b", r"\bseite nicht gefunden\b", r"\bpage introuvable\b", r"\berreur (?:4|5)\d\d\b", r"\bfehler (?:4|5)\d\d\b",
    ),
    "script_notice": (
        r"\b(?:enable|activate|turn on|switch on|allow|requires?|needs?|support)\b.{0,30}\b(?:javascript|java script|scripts?|scripting|cookies)\b", r"\b(?:javascript|scripts?|scripting|cookies)\b.{0,40}\b(?:disabled|is off|required|have to be allowed|missing|must be)\b",
        r"<noscript>", r"\bchecking your browser\b", r"\bunsupported browser\b", r"\b(?:aktivieren sie|necesita|activez|active|habilite) javascript\b",
    ),
}
#: Words of the usual dummy Latin (fixed values); three different ones mark a trusted passage.
_LATIN = frozenset("lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore aliqua nulla morbi porta ornare fusce vestibulum pulvinar".split())
EXAMPLES = (
    *[("placeholder", x) for x in (
        "{{ name }}", "{{name}}", "{% name %}", "${name}", "<%= name %>", "%(name)s", "@@name@@", "<<name>>", "[[name]]", "__CLIENT_NAME__", "%NAME%", "#CLIENT_NAME#", "##NAME##", "{client_name}", "{name}", "[INSERT name]", "[Your name]", "[CLIENT NAME]",
        "<insert name>", "<name here>", "(TODO: name)", "(TBD: date)", "XX/XX/XXXX", "$X,XXX.XX", "XXX-XX-XXXX", "mm/dd/yyyy",
    )],
    ("filler", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua nulla porta morbi ornare ultra fusca velum"),
    ("filler", "To be written."), ("filler", "Coming soon."), ("filler", "Content pending."), ("filler", "[text]"), ("filler", "(copy)"), ("filler", "xxxxx xxxx xxxxxx"),
    ("filler", "asdf qwer blah blah asdf test test 123 xxx xxx"), ("filler", "Intro TK."), ("filler", "TK TK."), ("filler", "Placeholder paragraph: write two sentences later."),
    ("filler", "This is a dummy paragraph. Replace it before publishing."), ("filler", "Text to follow once it has been drafted by the editors."), ("filler", "Your content here."),
    ("error_page", "404 Not Found"), ("error_page", "The page you requested could not be located."), ("error_page", "500 Internal Server Error"), ("error_page", "403 Access denied. You do not have permission to view this page."),
    ("error_page", "503 Service Temporarily Unavailable"), ("error_page", "Fatal error: Uncaught Exception"), ("error_page", "Error establishing a database connection"), ("error_page", "This document is no longer available."),
    ("error_page", "Oops! Something went wrong on our end."), ("error_page", "Too many requests. Wait seconds before trying again."), ("error_page", "Your session has expired. Sign in again."), ("error_page", "Try again later."),
    ("script_notice", "Please enable JavaScript to view this page."), ("script_notice", "JavaScript is disabled in your browser."), ("script_notice", "You need to turn on scripting to continue."), ("script_notice", "Enable scripts and cookies."),
    ("script_notice", "Checking your browser before access."), ("script_notice", "This application requires scripts. Check your settings and reload."), ("script_notice", "Unsupported browser"), ("script_notice", "Loading"),
)


class Seeds:
    """What labels the trusted passages; none of it is asked when records are judged."""

    def __init__(self, seeds: dict[str, Sequence[str]] = SEEDS, examples: Sequence[tuple[str, str]] = EXAMPLES, repeats: bool = True):
        any_of = lambda k, flags: re.compile("|".join(seeds[k]) or r"(?!)", flags)
        self.field = any_of("placeholder", 0)
        self.phrases = [(KINDS.index(k), any_of(k, re.I)) for k in ("error_page", "script_notice", "filler")]
        self.examples, self.repeats = examples, repeats

    def kind(self, text: str) -> int:
        """The class of a record that is trusted to be nothing but one kind of residue, else -1."""
        lines, found = [], []
        for p in _each_passage(text):
            kind = next((k for k, pattern in self.phrases if pattern.search(p)), 0)
            if not kind and self.repeats and len(_LATIN.intersection(re.findall("[a-z]+", p.lower()))) > 2:
                kind = 2
            if not kind and len(p.split()) > 9:
                return -1  # a sentence of content
            lines.append(p)
            found.append(kind)
        most, often = Counter(lines).most_common(1)[0] if lines else ("", 0)
        if self.repeats and often >= 3 and often * 5 >= len(lines) * 3 and len(most.split()) <= 6:  # one short sentence over and over
            found = [2 if p == most and not k else k for p, k in zip(lines, found)]
        kinds = {k for k in found if k}
        return kinds.pop() if len(kinds) == 1 else -1


def passages(text: str) -> list[str]:
    """Lines and sentences that are not blank."""
    return [p for p in _PASSAGES.split(text) if p and not p.isspace()]


def _each_passage(text: str):
    """The same one by one, for those who need the first few alone."""
    at = 0
    for m in _PASSAGES.finditer(text):
        if text[at : m.start()].strip():
            yield text[at : m.start()]
        at = m.end()
    if text[at:].strip():
        yield text[at:]


def span_features(span: str) -> list[bytes]:
    """Signs around a span, its shape and its words."""
    inner = span.strip("{}<>[]()%@_#$ ")
    opening, closing = (span.split(inner, 1) if inner else (span, ""))
    shape = re.sub("[a-zß-öø-ÿ]+", "a", re.sub("[A-ZÀ-ÖØ-Þ]+", "A", re.sub("[0-9]+", "9", span)))
    shape = re.sub(r"(?:([ _,]?)([aA9]))(?:\1\2)+", r"\1\2+", shape)
    words = [w for w in re.split("[^a-z0-9]+", inner.lower()) if w]
    found = [f"\x01o{opening.strip()} {closing.strip()}", f"\x01s{shape}", *(f"\x01w{w}" for w in words)]
    return [x.encode() for x in found]


class Cut:
    """All passages of some texts: owner (text number), words or features, whether it is a span, and the passage."""

    def __init__(self, texts: list[str]):
        self.owners: list[int] = []
        self.cut: list[str] = []
        self.spans: list[bool] = []
        for i, text in enumerate(texts):
            suspect = "(" in text or any(m in text for m in _SIGNS)
            for p in passages(text):
                inside: list[str] = []
                rest = SPAN.sub(lambda m: inside.append(m.group()) or " ", p) if suspect and ("(" in p or any(m in p for m in _SIGNS)) else p  # noqa: B023
                if not rest.isspace():
                    self.owners.append(i)
                    self.cut.append(rest)
                    self.spans.append(False)
                for span in inside:
                    self.owners.append(i)
                    self.cut.append(span)
                    self.spans.append(True)
        self.words = split_words(self.cut)
        known: dict[str, list[bytes]] = {}
        for j, (w, span) in enumerate(zip(self.words, self.spans)):
            if span:
                p = self.cut[j]
                if p not in known:
                    known[p] = span_features(p)
                self.words[j] = known[p]
            elif 0 < len(w) <= 6:  # a short message is also known as a whole
                w.append(b"\x02" + b" ".join(w))


def fit(texts: list[str], seeds: Seeds | None = None, trusted: list[tuple[int, str]] = (), rounds: int = ROUNDS) -> dict[bytes, np.ndarray]:
    """Log-odds against content of each word for the four kinds (under b'' those of the classes).

    `texts` are records of any class, `trusted` (class, text) further records and spans of one.
    """
    seeds = seeds or Seeds()
    labelled = [*trusted, *((KINDS.index(k), t) for k, t in seeds.examples)]
    own = [*(seeds.kind(t) for t in texts), *(k for k, _ in labelled)]
    part = Cut([*texts, *(t for _, t in labelled)])
    owners, words, spans, cut = part.owners, part.words, part.spans, part.cut
    first = list({(o, p): i for i, (o, p) in enumerate(zip(owners, cut))}.values())  # a passage counts once a record
    owners, words, spans, cut = ([x[i] for i in first] for x in (owners, words, spans, cut))
    vocabulary: dict[bytes, int] = {}
    lists = [[vocabulary.setdefault(w, len(vocabulary)) for w in set(ws)] for ws in words]
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    ids = np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum()))
    row = np.repeat(np.arange(len(lists)), counts)
    classes, size = len(KINDS), len(vocabulary)
    fixed = np.array([own[o] if own[o] > 0 else 1 if f and seeds.field.fullmatch(p) else -1 for o, f, p in zip(owners, spans, cut)], dtype=np.int64)
    resp = np.zeros((len(lists), classes))
    resp[:, 0] = 1.0
    resp[fixed > 0] = 0.0
    resp[fixed > 0, fixed[fixed > 0]] = 1.0
    free = np.flatnonzero(fixed < 0)
    # However many trusted passages a table has, they weigh as much as MASS of a class at most, so that large and small tables are judged alike.
    mass = np.bincount(fixed[fixed > 0], minlength=classes)
    weight = np.where(fixed > 0, np.minimum(1.0, MASS / np.maximum(1, mass))[fixed], 1.0)
    # A word's rate in a class is smoothed toward its rate in all passages, so that unknown words weigh nothing.
    overall = (np.bincount(ids, minlength=size) + 1.0) / (len(lists) + 2.0)
    for _ in range(rounds):
        totals = (resp * weight[:, None]).sum(axis=0)
        log_rate = np.empty((size, classes))
        for k in range(classes):
            seen = np.bincount(ids, weights=resp[row, k] * weight[row], minlength=size)
            log_rate[:, k] = np.log((seen + 2.0 * overall) / (totals[k] + 2.0))
        prior = np.log((totals + 1.0) / (totals.sum() + classes))
        score = np.stack([np.bincount(row, weights=log_rate[ids, k], minlength=len(lists)) for k in range(classes)], axis=1) + prior
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        resp[free] = (p / p.sum(axis=1, keepdims=True))[free]
    weights = (log_rate[:, 1:] - log_rate[:, :1]).clip(-12, 12).astype(np.float32)
    model = {w: weights[i] for w, i in vocabulary.items()}
    model[b""] = (prior[1:] - prior[0]).astype(np.float32)
    return model


class Scorer:
    """Scores passages with a fitted model and decides on records."""

    def __init__(self, model: dict[bytes, np.ndarray], least: int = LEAST):
        self.prior, self.least = model[b""], least
        self.numbers = {w: i + 1 for i, w in enumerate(w for w in model if w)}
        self.table = np.vstack([np.zeros(4, np.float32), *(model[w] for w in self.numbers)])

    def scores(self, words: list[list[bytes]]) -> np.ndarray:
        """Log-odds of each passage for the four kinds against content."""
        lists = [set(w) for w in words]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in chain.from_iterable(lists)), np.int64, int(counts.sum()))
        row = np.repeat(np.arange(len(lists)), counts)
        return np.stack([np.bincount(row, weights=self.table[ids, k], minlength=len(lists)) for k in range(4)], axis=1) + self.prior

    def kinds(self, texts: list[str]) -> np.ndarray:
        """Class of each record, 0 for content."""
        found = np.zeros(len(texts), np.int64)
        part = Cut(texts)
        if not part.owners:
            return found
        owner, span = np.array(part.owners), np.array(part.spans)
        score = self.scores(part.words)
        best = score.argmax(axis=1)
        kind = np.where(score[np.arange(len(best)), best] > 0, best + 1, 0)
        size = np.array([max(1, len(p.split())) for p in part.cut])
        heading = np.array([p.rstrip()[-1:] not in ".!?:;。！？" and (len(p.split()) <= 9 or " > " in p or " | " in p) for p in part.cut])
        weight = np.stack([np.bincount(owner, weights=size * (kind == k), minlength=len(texts)) for k in range(5)], axis=1)
        sentences = np.bincount(owner, weights=size * ((kind == 0) & ~heading & ~span), minlength=len(texts))
        field = np.bincount(owner, weights=(kind == 1) & span, minlength=len(texts)) > 0
        longest = np.zeros(len(texts))
        np.maximum.at(longest, owner, size * (kind == 2))
        message = weight[:, 3] + weight[:, 4]
        # Menus and footers go with either kind of message, so the passages' evidence and not their length tells which it is.
        error, script = (np.bincount(owner, weights=score[:, k - 1] * (kind >= 3), minlength=len(texts)) for k in (3, 4))
        found = np.where(message > sentences, np.where(error >= script, 3, 4), found)
        filler = (longest >= self.least) | (weight[:, 2] * 3 > sentences)
        found = np.where(filler & (weight[:, 2] >= message), 2, found)
        return np.where(field, 1, found)


def _judge(shared):
    def judge(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            kind = scorer.kinds(batch.column(1).to_pylist())
            at = np.flatnonzero(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([KINDS[k] for k in kind[at]], pa.string())], names=["doc_id", "kind"])

    return judge


def _form(text: str) -> str:
    return re.sub("[0-9]+", "#", " ".join(text.lower().split()))


def _trusting(seeds: Seeds):
    """kind, text of the trusted records and spans of a table, one for each form in a batch."""

    def trust(batches):
        for batch in batches:
            found: dict[tuple[int, str], str] = {}
            for text in batch.column(0).to_pylist():
                kind = seeds.kind(text)
                if kind > 0:
                    found.setdefault((kind, _form(text)), text)
                elif seeds.field.search(text):
                    for span in SPAN.findall(text):
                        if seeds.field.fullmatch(span):
                            found.setdefault((1, _form(span)), span)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([f for _, f in found], pa.string()), pa.array(list(found.values()), pa.string())], names=["kind", "form", "text"])

    return trust


def _some(rows: DataFrame, place: Column, most: int) -> DataFrame:
    """All of at most 0.9 `most` rows, else about as many, chosen by hash; never more than `most`."""
    share = min(1.0, 0.9 * most / max(1, rows.count()))
    return rows.where(F.pmod(place, F.lit(1_000_000_000)) < int(1_000_000_000 * share)).limit(most)


def residue(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seeds: Seeds | None = None) -> DataFrame:
    """doc_id, kind of every record that holds residue in place of content."""
    seeds = seeds or Seeds()
    rows = documents.where(F.col(doc_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("_text"))
    forms = durable(rows.select("_text").mapInArrow(_trusting(seeds), "kind int, form string, text string").groupBy("kind", "form").agg(F.min("text").alias("text")))
    trusted = [tuple(r) for r in _some(forms, F.xxhash64("kind", "form"), sample).select("kind", "text").collect()]
    texts = [r[0] for r in _some(rows, F.xxhash64("doc_id"), sample).select("_text").collect()]
    shared = documents.sparkSession.sparkContext.broadcast(fit(texts, seeds, trusted))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_judge(shared), f"doc_id {kind}, kind string").groupBy("doc_id").agg(F.min("kind").alias("kind"))
