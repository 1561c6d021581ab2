"""Repair of text from scanned pages by noisy-channel decoding.

One pass over all texts counts words and adjacent word pairs (a corpus bigram
model); both counts are exact. The `lexicon` most frequent words and the
`bigrams` most frequent pairs are broadcast; what a page needs beyond them gets
its counts by a join, so the two sizes change the plan and not the result. An
observed word and a true one are confusable if they have the same skeleton, a
form in which every misreading of the confusion table looks alike, so
candidates are looked up and not searched for. Each line with a doubtful word
is decoded by Viterbi: the product of character confusion probabilities and
bigram likelihood picks one candidate a word.

Before that, printed page numbers and running headers are taken from the
lines, and words divided at a line end are joined, with a hyphen where the
hyphenated word is the known one. What was wrong is reported by kind.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.operators.nested import newest
from corpuskiln.session import durable

LEXICON = 100_000
BIGRAMS = 1_000_000
#: Probability that a character group is misread as one of its confusions.
CONFUSION = 0.03
#: A reading that its neighbours would have to make this many times likelier than its frequency does isn't weighed.
CONTEXT = 100.0
#: What a form with signs or digits inside counts as: it is no word, however often it occurs.
NO_WORD = 0.001
_ALL = (1 << 64) - 1

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿﬀ-ﬆ"
_TOKEN = re.compile(rf"[{_LETTERS}0-9|!+][{_LETTERS}0-9|!+'’-]*")
_NEWLINE = re.compile(r"\r\n?|[\x0b\x0c\x85\u2028\u2029]")
#: Each observed or true character group and the common form of all that look like it (fixed values).
_LOOKS = {
    "l": "i", "1": "i", "|": "i", "!": "i", "j": "i",
    "h": "ii", "u": "ii", "n": "ri", "m": "rri", "d": "ci", "w": "vv",
    "e": "c", "0": "o", "5": "s", "6": "b", "9": "g", "+": "t", "8": "b",
}
_SKELETON = str.maketrans(_LOOKS)
_SIGNS = "-¬­‐‑"
_DIVIDED = re.compile(rf"([^\W\d_|!+]*[\w|!+])[{_SIGNS}]([ \t]*\n[ \t]*|[ \t]+)([\w|!+]+)|(\w)[¬­](\w)")


def skeleton(word: str) -> str:
    """The common form of all that looks like `word`; letters with marks look like those without."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return word.lower().translate(_SKELETON)


def tokens(text: str) -> list[str]:
    """Words as the language model sees them: lower case, plain numbers as #."""
    return [t if not t[0].isdigit() or any(c.isalpha() for c in t) else "#" for t in _TOKEN.findall(text.lower())]


def _seen(token: str) -> str:
    return token.lower() if not token[0].isdigit() or any(c.isalpha() for c in token) else "#"


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = value
        return value


def pair_hashes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of word hashes."""
    x = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + after.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


class _PairSum:
    """Counts of pair hashes, merged when many have come together."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, pairs: np.ndarray) -> None:
        self.parts.append(np.unique(pairs, return_counts=True))
        self.held += len(self.parts[-1][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.empty(0, np.int64) for i in (0, 1))
        values, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(values)).astype(np.int64)
        self.parts, self.held = [(values, total)], len(values)
        return values, total


def _count(batches):
    """Word counts and pair counts of a task."""
    words, pairs, hashes = Counter(), _PairSum(), _Hashes()
    schema = pa.schema([("word", pa.string()), ("pair", pa.int64()), ("n", pa.int64())])

    def flush_words():
        keys = list(words)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.nulls(len(keys), pa.int64()), pa.array([words[k] for k in keys], pa.int64())], schema=schema)
        words.clear()

    def flush_pairs():
        keys, counts = pairs.merged()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.string()), pa.array(keys), pa.array(counts)], schema=schema)
        pairs.__init__()

    for batch in batches:
        lists = [tokens(t) for t in batch.column(0).to_pylist() if t]
        for found in lists:
            words.update(found)
        h = np.fromiter((hashes[w] for found in lists for w in ("", *found)), dtype=np.uint64)
        if len(h) > 1:
            pairs.add(pair_hashes(h[:-1], h[1:]))
        if len(words) > 500_000:
            yield from flush_words()
        if pairs.held > 4_000_000:
            pairs.merged()
            if pairs.held > 2_000_000:
                yield from flush_pairs()
    yield from flush_words()
    yield from flush_pairs()


class Channel:
    """The noisy channel: lexicon, confusions and bigram likelihood."""

    def __init__(self, words: dict[str, int], pairs: tuple[np.ndarray, np.ndarray], confusion: float = CONFUSION, total: int | None = None):
        """`words` to counts, and `pairs`: sorted hashes and counts."""
        self.words, self.pairs, self.confusion = words, pairs, confusion
        self.rare_pairs: dict[int, int] = {}
        self.likely: dict[tuple[str, str], float] = {}
        self.total = max(1, sum(words.values()) if total is None else total)
        self.index = self._by_skeleton(words)
        self.rare: dict[str, int] = {}
        self.rare_index: dict[str, list[str]] = {}
        self.known: dict[str, list[tuple[str, float]]] = {}
        self.hashes = _Hashes()

    @staticmethod
    def _by_skeleton(words: dict[str, int]) -> dict[str, list[str]]:
        index: dict[str, list[str]] = {}
        for w, n in words.items():
            if n > 1 and len(w) > 1 and w.replace("-", "").replace("'", "").replace("’", "").isalpha() and w.isascii():
                index.setdefault(skeleton(w), []).append(w)
        return index

    def look_up(self, rare: dict[str, int], pairs: dict[int, int] | None = None) -> None:
        """The words beyond `words` that the next text may need, most frequent first, and its pairs beyond `pairs`."""
        if rare or self.rare:
            self.known.clear()
        if rare or self.rare or pairs or self.rare_pairs:
            self.likely.clear()
        self.rare, self.rare_index, self.rare_pairs = rare, self._by_skeleton(rare), pairs or {}

    def count(self, word: str) -> int:
        return self.words.get(word) or self.rare.get(word, 0)

    def alike(self, word: str) -> list[str]:
        key = skeleton(word)
        return [*self.index.get(key, ()), *self.rare_index.get(key, ())]

    @staticmethod
    def counted(word: str) -> bool:
        """Whether a form's own count matters."""
        return word == "#" or word.isascii() and word.replace("-", "").replace("'", "").isalpha()

    @staticmethod
    def readable(word: str) -> bool:
        """Whether a form may be a misread word."""
        letters = sum(c.isalpha() for c in word)
        return len(word) > 1 and letters > 0 and not re.fullmatch(r"[#$]?\d[\d.,-]*[a-z]?[a-z]?|[\d-]+[a-z]{0,3}", word) and letters * 2 >= len(word)

    def frequency(self, word: str) -> float:
        """Occurrences beside the one at hand."""
        return max(self.count(word) - 1.0, 0.5) if self.counted(word) else NO_WORD

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """True words that may have been misread as `word`, with the log of the confusions' probability."""
        found = self.known.get(word)
        if found is None:
            found = []
            if self.readable(word):
                own = math.log(self.frequency(word) / CONTEXT)
                for w in self.alike(word):
                    if w != word and math.log(self.count(w)) + math.log(self.confusion) > own:
                        blocks = sum(op[0] != "equal" for op in SequenceMatcher(None, word, w, autojunk=False).get_opcodes())
                        cost = blocks * math.log(self.confusion)
                        if math.log(self.count(w)) + cost > own:
                            found.append((w, cost))
            if len(self.known) < 1_000_000:
                self.known[word] = found
        return found

    def pair(self, before: str, word: str) -> int:
        return int(pair_hashes(np.array([self.hashes[before]], np.uint64), np.array([self.hashes[word]], np.uint64))[0])

    def common(self, pair: int) -> int:
        """The count of a broadcast pair; 0 if it isn't one."""
        keys, counts = self.pairs
        at = int(np.searchsorted(keys, pair))
        return int(counts[at]) if at < len(keys) and keys[at] == pair else 0

    def together(self, before: str, word: str) -> float:
        """How often the pair occurs; pairs that occur once count as none."""
        pair = self.pair(before, word)
        return float(self.common(pair) or self.rare_pairs.get(pair, 0))

    def likelihood(self, before: str, word: str) -> float:
        """The log of the word's probability after another, drawn toward its overall frequency."""
        known = self.likely.get((before, word))
        if known is not None:
            return known
        own, n = self.frequency(word), self.frequency(before) if before else 1.0
        both = self.together(before, word) if own > 1 else 0.0
        both = max(0.0, min(both, n, own) - 1.0)  # a word doesn't speak for itself
        value = math.log((both + 20.0 * own / self.total) / (n + 20.0))
        if len(self.likely) < 1_000_000:
            self.likely[before, word] = value
        return value

    def asked_pairs(self, text: str) -> set[int]:
        """The pairs beyond the broadcast ones that decoding the text's lines looks up."""
        found = set()
        for row in text.split("\n"):
            line = [_seen(t) for t in _TOKEN.findall(row)]
            options = [[w, *(c for c, _ in self.candidates(w))] for w in line]
            for i, now in enumerate(options):
                before = options[i - 1] if i else [""]
                if len(now) > 1 or len(before) > 1:
                    found.update(p for a in before for b in now if not self.common(p := self.pair(a, b)))
        return found

    def decode(self, line: list[str]) -> list[str]:
        """The likeliest true words of a line, by Viterbi.

        A step between two words of one reading each is the same on every path and left out.
        """
        best: list[tuple[float, list[str]]] = [(0.0, [])]
        before = [""]
        for w in line:
            options = [(w, 0.0), *self.candidates(w)]
            fresh = []
            for word, cost in options:
                if len(options) == 1 and len(before) == 1:
                    score, at = best[0][0], 0
                else:
                    score, at = max((best[k][0] + self.likelihood(before[k], word), k) for k in range(len(before)))
                fresh.append((score + cost, [*best[at][1], word]))
            best, before = fresh, [w for w, _ in options]
        return max(best, key=lambda b: b[0])[1]

    def is_word(self, word: str) -> bool:
        word = word.lower()
        return self.count(word) > 2 or any(self.count(w) > 2 for w in self.alike(word))

    def beyond(self, tokens: set[str], joins: set[str]) -> set[str]:
        """Skeletons under which a text's tokens and joined words need more than `words`.

        A frequent word needs none: one beyond `words` is never often enough to be its candidate.
        """
        needed = {w for w in tokens if (w not in self.words and self.counted(w)) or (not self.counted(w) and self.readable(w))}
        return {skeleton(w) for w in needed | {w for w in joins if w not in self.words}}

    def repair(self, text: str) -> tuple[str, bool]:
        """A line with misread words put right, and whether there were any."""
        spans = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
        line = [_seen(t) for *_, t in spans]
        if not any(self.candidates(w) for w in set(line)):
            return text, False
        decoded, out, at, changed = self.decode(line), [], 0, False
        for (start, end, raw), was, now in zip(spans, line, decoded):
            out.append(text[at:start])
            if was != now:
                changed = True
                upper = sum(c.isupper() for c in raw)
                now = now.upper() if upper > 1 and upper * 2 > sum(c.isalpha() for c in raw) else now.capitalize() if raw[:1].isupper() else now
                out.append(now)
            else:
                out.append(raw)
            at = end
        return "".join([*out, text[at:]]), changed


# --- lines ----------------------------------------------------------------

_NUMBER_LINE = re.compile(r"^\s*(?:[-–—\[(]+\s*(\d+)\s*[-–—\])]+|(?:p\s?a\s?g\s?e|pg\.?|p\.)\s*(\d+)(?:\s*(?:of|/)\s*\d+)?\.?|(\d+)(?:\s*(?:of|/)\s*\d+)?(\.?))\s*$", re.I)
_BESIDE = re.compile(r"^\s*(?:(?:page|pg\.?)\s*(\d+)|(\d+))\s{2,}(?=\S)|(?<=\S)\s{2,}(?:(?:page|pg\.?)\s*(\d+)|(\d+))\s*$", re.I)
#: What stands in a running header beside the name of the source (fixed values, matched by skeleton).
_EDITION = re.compile("|".join(skeleton(p).replace("#", r"\d") for p in ("tax year", "instructions", "continued", "department copy", "cat. no.", "catalog number", "edition", "revised", "rev.", "draft", "final")))
_CHAPTER = re.compile(rf"^\s*(?:{skeleton('chapter')}|{skeleton('part')}|{skeleton('section')})\s+(?:\d+|[ivxlcdm]+)(?:\s{{2,}}|\s*[:.–—-]\s+)\S")
_TERMINAL = re.compile(r"[.!?:;][\"'”’)\]]*\s*$")


def _keep_digits(text: str) -> str:
    """The skeleton of a line in which whole numbers stay as they are."""
    return re.sub(r"\S+", lambda m: m.group().lower() if re.fullmatch(r"[\W\d]*\d[\W\d]*[A-Za-z]?\W*", m.group()) else skeleton(m.group()), text)


def page_number(line: str, lines: list[str], at: int, first: int, last: int) -> bool:
    m = _NUMBER_LINE.match(line)
    if not m:
        return False
    number = int(next(g for g in m.groups()[:3] if g))
    if not first <= number <= last:
        return bool(m.group(2)) and not m.group(2).startswith("0") and first - 1 <= number <= last + 1
    if m.group(4):  # "8." may be the end of a sentence that was wrapped
        rest = next((x for x in reversed(lines[:at]) if x.strip()), "")
        later = any(x.strip() for x in lines[at + 1 :])
        return later or not rest or bool(_TERMINAL.search(rest))
    return True


def running_header(line: str, label: str) -> tuple[bool, str]:
    """Whether a line is a page header or footer; and the line without a page number beside it."""
    if not any(c.isdigit() for c in line) and any(c.isdigit() for c in label):  # a chapter or a name with a number
        return False, line
    core = _BESIDE.sub("", line)
    body = _keep_digits(core)
    if _CHAPTER.match(body) and not _TERMINAL.search(core):
        return True, core
    name = _keep_digits(label).strip() if label else ""
    if name and name in " ".join(body.split()):
        rest = " ".join(body.split()).replace(name, " ", 1)
        cue = bool(_EDITION.search(rest)) or bool(re.search(r"\(?\b(?:19|20)\d\d\b\)?", rest))
        rest = _EDITION.sub(" ", rest)
        rest = re.sub(r"\b(?:19|20)\d\d\b|\b\d{4,6}[A-Za-z]?\b", " ", rest)
        if cue and not re.search(r"[^\W_]{2,}", rest) and not re.search(r"\.\s*$", core):
            return True, core
    return False, core


def joined(text: str, channel: Channel) -> tuple[str, bool]:
    """Text with divided words joined, and whether there were any."""
    seen = False

    def join(m: re.Match) -> str:
        nonlocal seen
        if m.group(4):
            seen = True
            return m.group(4) + m.group(5)
        left, gap, right = m.group(1), m.group(2), m.group(3)
        sign = m.group(0)[len(left)]
        broken = "\n" in gap
        if sign in "¬­":
            seen = True
            hyphen = "-" if channel.count(f"{left}-{right}".lower()) > 2 and not channel.is_word(left + right) else ""
            return left + hyphen + right + ("\n" if broken else " ")
        if not any(c.islower() for c in right[:2]) and not left.isupper() or left.isdigit():
            return m.group(0)
        compound = channel.count(f"{left}-{right}".lower())
        whole = channel.is_word(left + right)
        if not whole and not compound and not broken:
            return m.group(0)
        if compound > 2 and compound >= channel.count((left + right).lower()):
            seen = True
            return f"{left}-{right}" + ("\n" if broken else " ")
        if whole or not (channel.count(left.lower()) > 2 and channel.count(right.lower()) > 2):
            seen = True
            return left + right + ("\n" if broken else " ")
        return m.group(0)

    return _DIVIDED.sub(join, text), seen


def _forms(m: re.Match) -> tuple[str, str, str]:
    """All that `joined` may make of a match."""
    if m.group(4):
        return (m.group(4) + m.group(5),) * 3
    left, right, end = m.group(1), m.group(3), "\n" if "\n" in m.group(2) else " "
    return m.group(0), left + right + end, f"{left}-{right}{end}"


def asked(body: str, removed: list[str]) -> tuple[set[str], set[str]]:
    """The tokens that a text may have once divided words are joined, and the words that `joined` looks up.

    Every form holds a blank, so a token touches two neighbouring matches at most: all
    pairs of forms of even and odd matches give every token.
    """
    divided = [m for m in _DIVIDED.finditer(body) if not m.group(4)]
    place = {m.start(): i % 2 for i, m in enumerate(divided)}
    pairs = [(a, b) for a in range(3) for b in range(3)] if divided else [(0, 0)]
    texts = [_DIVIDED.sub(lambda m: _forms(m)[pair[place.get(m.start(), 0)]], body) for pair in pairs]  # noqa: B023
    joins = {w.lower() for m in divided for w in (f"{m.group(1)}-{m.group(3)}", m.group(1) + m.group(3), m.group(1), m.group(3))}
    return {_seen(t) for x in (*texts, *removed) for t in _TOKEN.findall(x)}, joins


def running_text(text: str, label: str, first: int | None, last: int | None) -> tuple[str, list[str], set[str]]:
    """The text without page numbers and running headers, the headers, and the kinds of noise so far."""
    found = set()
    low = min(x for x in (first, last, 10**9) if x is not None)
    high = max(x for x in (first, last, -1) if x is not None)
    lines, kept, removed = _NEWLINE.sub("\n", text).split("\n"), [], []
    for at, line in enumerate(lines):
        if len(lines) > 1 and line.strip():
            if page_number(line, lines, at, low, high):
                found.add("page_number")
                continue
            header, core = running_header(line, label)
            if header:
                found.add("running_header")
                beside = _BESIDE.search(line)
                if beside and low <= int(next(g for g in beside.groups() if g)) <= high:
                    found.add("page_number")
                removed.append(core)
                continue
        kept.append(line)
    return "\n".join(kept), removed, found


def clean(text: str, label: str, first: int | None, last: int | None, channel: Channel) -> tuple[str, list[str]]:
    """The repaired running text, and the kinds of noise that were in it."""
    body, removed, found = running_text(text, label, first, last)
    body, divided = joined(body, channel)
    if divided:
        found.add("hyphenation")
    out = []
    for line in body.split("\n"):
        fixed, misread = channel.repair(line)
        if misread:
            found.add("misread")
        out.append(fixed.strip())
    if any(channel.repair(line)[1] for line in removed):
        found.add("misread")
    paragraphs = re.split(r"\n\s*\n", "\n".join(out))
    return "\n\n".join(" ".join(p.split()) for p in paragraphs if p.strip()), sorted(found)


def _label(section: str | None) -> str:
    return (section or "").split(":")[0]


def _channel(shared) -> Channel:
    words, keys, counts, total = shared.value
    return Channel(words, (keys, counts), total=total)


def _rare(rows) -> dict[str, int]:
    found = {(r["word"], r["n"]) for r in rows or ()}
    return dict(sorted(found, key=lambda r: (-r[1], r[0])))


def _cleaner(shared, names: list[str]):
    def work(batches):
        channel = _channel(shared)
        for batch in batches:
            rows = {n: batch.column(n).to_pylist() for n in names}
            none = [None] * batch.num_rows
            done = []
            for s, a, z, t, rare, pairs in zip(rows["section_id"], rows["page_start"], rows["page_end"], rows["text"], rows.get("rare", none), rows.get("pairs", none)):
                if "rare" in rows or "pairs" in rows:
                    channel.look_up(_rare(rare), {r["pair"]: r["n"] for r in pairs or ()})
                done.append(clean(t, _label(s), a, z, channel))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))], names=["id", "text", "noise"]
            )

    return work


def _asker(shared):
    """id, key: the skeletons under which a page needs words beyond the broadcast ones."""

    def work(batches):
        channel = _channel(shared)
        for batch in batches:
            ids, keys = [], []
            for id_, s, a, z, t in zip(*(c.to_pylist() for c in batch.columns)):
                body, removed, _ = running_text(t, _label(s), a, z)
                found = sorted(channel.beyond(*asked(body, removed)))
                keys += found
                ids += [id_] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.string())], names=["id", "key"])

    return work


def _pair_asker(shared):
    """id, pair: the pairs beyond the broadcast ones that a page needs."""

    def work(batches):
        channel = _channel(shared)
        for batch in batches:
            ids, keys = [], []
            for id_, s, a, z, t, *rare in zip(*(c.to_pylist() for c in batch.columns)):
                channel.look_up(_rare(rare[0]) if rare else {})
                body, removed, _ = running_text(t, _label(s), a, z)
                found = sorted(channel.asked_pairs("\n".join([joined(body, channel)[0], *removed])))
                keys += found
                ids += [id_] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.int64())], names=["id", "pair"])

    return work


def _keyed(batches):
    for batch in batches:
        words = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([skeleton(w) for w in words], pa.string()), batch.column(0), batch.column(1)], names=["key", "word", "n"])


def _top(counts: DataFrame, key: str, most: int) -> tuple[pa.Table, bool]:
    """The `most` greatest counts (then least keys), and whether these are all."""
    found = counts.orderBy(F.desc("n"), key).limit(most + 1).toArrow()
    return found.slice(0, most), found.num_rows <= most


def _beyond(counts: DataFrame, key: str, top: pa.Table) -> DataFrame:
    """The counts that are not in a non-empty `top`."""
    last_key, last = top.column(key)[-1].as_py(), top.column("n")[-1].as_py()
    return counts.where((F.col("n") < last) | (F.col("n") == last) & (F.col(key) > last_key))


def statistics(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n of all words; pair, n of all pairs that occur twice or more) over all texts of a one-column table."""
    counted = durable(texts.mapInArrow(_count, "word string, pair long, n long"))
    words = counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    pairs = counted.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
    return durable(words), durable(pairs)


def repaired(chunks: DataFrame, lexicon: int = LEXICON, bigrams: int = BIGRAMS) -> DataFrame:
    """id, text, noise (array of kinds) for the newest row of each PDF chunk, i.e. with a page_start or page_end.

    The corpus statistics cover all chunks' texts, words and pairs; `lexicon`
    and `bigrams` (1 or more) are how many of them are broadcast and have no
    effect on the result. Null and blank texts have no noise; a null text stays
    null and is left out. An empty table gives an empty result.
    """
    words, pairs = statistics(chunks.select("text").where("text is not null"))
    top, all_words = _top(words, "word", lexicon)
    often, all_pairs = _top(pairs, "pair", bigrams)
    total = words.agg(F.sum("n")).first()[0]
    keys, counts = often.column("pair").to_numpy(), often.column("n").to_numpy()
    order = np.argsort(keys)
    shared = chunks.sparkSession.sparkContext.broadcast((dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist())), keys[order], counts[order], total or 0))
    pages = newest(chunks.select("id", "section_id", "page_start", "page_end", "text", "ingested_at"), "id", "ingested_at")
    pages = pages.where("text is not null and (page_start is not null or page_end is not null)").select("id", "section_id", "page_start", "page_end", "text")
    if not all_words:
        beyond = _beyond(words, "word", top).where((F.col("n") > 1) | F.contains("word", F.lit("-")))  # a single one counts as none, but for a compound
        lists = pages.mapInArrow(_asker(shared), "id string, key string").join(beyond.mapInArrow(_keyed, "key string, word string, n long"), "key")
        pages = pages.join(lists.groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("rare")), "id", "left")
        pages = durable(pages) if not all_pairs else pages
    if not all_pairs:
        needed = pages.mapInArrow(_pair_asker(shared), "id string, pair long").join(_beyond(pairs, "pair", often), "pair")
        pages = pages.join(needed.groupBy("id").agg(F.collect_list(F.struct("pair", "n")).alias("pairs")), "id", "left")
    return pages.mapInArrow(_cleaner(shared, pages.columns), "id string, text string, noise array<string>")


def noise(chunks: DataFrame, lexicon: int = LEXICON, bigrams: int = BIGRAMS) -> DataFrame:
    """id, noise: one row per chunk and kind of noise."""
    return repaired(chunks, lexicon, bigrams).select("id", F.explode("noise").alias("noise"))
