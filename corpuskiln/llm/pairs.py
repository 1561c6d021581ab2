"""Defects of question-answer pairs: empty, truncated, refusal, copied, language.

* Truncation: a pushdown parser reads the answer through fences, brackets,
  quotations, list markers and markup and, within them, through phrases: a
  determiner, preposition, conjunction, auxiliary, subordinator or word that
  needs a follower opens one, and what completes it closes it. What is left
  open at the end breaks off, as do an ellipsis, a marker without its item and
  the beginning of a word. Which words need a follower is counted over all
  answers: how often phrases end with them.
* Copies: greedy string tiling of the answer with the question.
* Languages: scripts, then function words and letters of each language.
* Refusals: a grammar with productions for agents, modals, negations, acts of
  speech, limits and rules, parsed from every token.

One row per id and at most one defect: of several different rows of an id the
one with the least (question, answer) counts. Null ids are left out. A null
question can't be copied nor tell a language.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.session import durable

#: Words whose counts are broadcast; those of further words are joined to the answers that hold them.
LEXICON = 200_000

_INVISIBLE = re.compile("[\\s\u00a0\u00ad\u200b-\u200f\u2028-\u202f\u2060\ufeff]+")
#: Stand-ins for "nothing here" and lead words (fixed values).
_NOTHING = frozenset(
    (
        "n/a|na|nan|none|null|nil|nill|undefined|missing|empty|blank|unknown|tbd|tba|tbc|todo|pending|no answer|not available|not applicable|not provided|no response|no data|no answer given|"
        "no answer provided|left blank|intentionally left blank|to be determined|to be added|to follow|see above|answer|answers|a|response|reply|ans|output|respuesta|réponse|antwort|ответ|the answer is|here is the answer|the answer"
    ).split("|")
)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    text = _INVISIBLE.sub(" ", answer).strip()
    core = text.strip(" .:;,!?-–—_*#~|/\\()[]{}<>\"'`…•=+").lower()
    if not core:
        return not any(c.isalnum() for c in text)
    return core in _NOTHING


# --- refusals -------------------------------------------------------------

#: Productions (fixed values): alternatives of terminals, NONTERMINALS, optional? parts and ~n, a gap of up to n tokens of the sentence.
_GRAMMAR = {
    "REFUSAL": (
        "AGENT BE? UNABLE TO? ~7 SPEECH", "AGENT MODAL not ADVERB? PERMIT? ~4 ACT", "AGENT WILLING not", "AGENT MUST DECLINE", "AGENT DECLINE TO? ~2 SPEECH", "AGENT LACK ~2 MEANS",
        "BEYOND ~2 LIMIT", "NOTHING CANBE? OFFERED", "NOTHING that? AGENT BE PERMITTED", "not something AGENT ABILITY", "let us TALK about something OTHER", "let us change ~2 SUBJECT",
        "answering ~7 WOULD", "GIVING ~10 RISK be HARMFUL", "MACHINE SKIPPED", "RULES ~5 FORBID", "AGENT BE MADE to AVOID", "AGENT BE MADE not to", "not be appropriate for me", "inappropriate for me", "against my RULE", "as an ai",
        "lo siento ~7 no puedo", "no puedo HABLAR", "je REGRETTE ~10 ne PEUX", "ne peux pas REPONDRE", "es tut mir leid ~10 kann", "kann ich? ~4 nicht ANTWORTEN",
    ),
    "AGENT": ("i", "we", "MACHINE", "RULES"),
    "MACHINE": ("this DEVICE", "the DEVICE"),
    "DEVICE": ("assistant", "system", "tool", "service", "model", "bot"),
    "RULES": ("my RULE",),
    "RULE": ("role", "guidelines", "policy", "policies", "instructions", "purpose", "programming"),
    "BE": ("am", "is", "are", "was", "have been"),
    "CANBE": ("can be", "may be", "will be"),
    "UNABLE": ("not ABLE", "unable", "barred", "forbidden", "prohibited"),
    "ABLE": ("able", "allowed", "permitted", "authorized", "authorised", "in a position", "qualified", "equipped"),
    "PERMITTED": ("permitted", "allowed", "able"),
    "ABILITY": ("can", "may", "could", "will", "am able to"),
    "TO": ("to", "from"),
    "MODAL": ("can", "could", "will", "may", "must", "do", "does"),
    "ADVERB": ("really", "currently", "possibly"),
    "PERMIT": ("permit", "allow", "be able to", "let me", "want to", "wish to", "offer", "give", "provide"),
    "WILLING": ("would rather", "prefer", "would prefer"),
    "MUST": ("must", "have to", "need to", "will have to"),
    "DECLINE": ("decline", "refuse", "pass", "must decline", "have to decline"),
    "SPEECH": (
        "answer", "respond", "reply", "assist", "help", "advise", "advice", "advising", "discuss", "comment", "say", "speak", "talk", "cover", "handle", "provide", "offer", "give", "guide", "guidance",
        "address", "engage", "share", "disclose", "weigh in", "elaborate", "go into", "tell", "explain",
    ),
    "ACT": ("SPEECH",),
    "LACK": ("do not have", "do not", "lack", "have no"),
    "MEANS": ("access", "knowledge", "expertise", "authority", "training", "information", "standing", "means"),
    "BEYOND": ("outside", "beyond", "not within", "out of"),
    "LIMIT": ("what AGENT", "my SCOPE", "the SCOPE"),
    "SCOPE": ("scope", "remit", "role", "abilities", "capabilities", "capability"),
    "NOTHING": ("no answer", "nothing"),
    "OFFERED": ("offered", "given", "said"),
    "TALK": ("talk", "speak", "chat"),
    "OTHER": ("else", "other"),
    "SUBJECT": ("something else", "subject", "topic"),
    "WOULD": ("would mean", "would require", "could be", "would be", "is not"),
    "GIVING": ("giving", "offering", "providing"),
    "RISK": ("could", "would", "might"),
    "HARMFUL": ("harmful", "inappropriate", "unsafe", "irresponsible"),
    "SKIPPED": ("skipped", "declined", "refused", "withheld", "passed", "skips", "declines", "refuses", "may not", "can not"),
    "FORBID": ("not", "never", "prevent", "prevents", "forbid", "forbids", "prohibit", "prohibits", "bar", "bars"),
    "MADE": ("set up", "told", "trained", "instructed", "designed", "configured", "programmed", "built"),
    "AVOID": ("avoid", "decline", "refuse"),
    "HABLAR": ("responder", "ayudar"),
    "REGRETTE": ("suis désolé", "regrette"),
    "PEUX": ("peux", "puis"),
    "REPONDRE": ("répondre", "aider"),
    "ANTWORTEN": ("beantworten", "helfen"),
}
#: Contracted forms in full, as the grammar's terminals have them (fixed values).
_CONTRACTED = re.compile(r"\b(ca|wo|do|does|could|would|is|are|was|did|should)n't\b|\bcannot\b|'(m|d|ll|ve|re)\b|\blet's\b")
_FULL = {"m": " am", "d": " would", "ll": " will", "ve": " have", "re": " are"}
_STEMS = {"ca": "can", "wo": "will"}
_SENTENCE_END = frozenset(".!?;")
#: Without any of these no sentence is a refusal.
_TRIGGERS = frozenset("i we my me us assistant system tool service model bot answer answering giving offering providing nothing puedo peux puis kann".split())


def _in_full(m: re.Match) -> str:
    if m.group(1):
        return _STEMS.get(m.group(1), m.group(1)) + " not"
    return _FULL[m.group(2)] if m.group(2) else "can not" if m.group() == "cannot" else "let us"


class Grammar:
    """Recognises phrases of a grammar without recursion through itself, by memoised descent."""

    def __init__(self, productions: dict[str, tuple[str, ...]]):
        self.rules = {k: [p.split() for p in v] for k, v in productions.items()}

    def ends(self, symbol: str, at: int, tokens: list[str], memo: dict) -> frozenset[int]:
        """Where a phrase of `symbol` that begins at a token may end."""
        if symbol not in self.rules:
            return frozenset((at + 1,)) if at < len(tokens) and tokens[at] == symbol else frozenset()
        if (symbol, at) not in memo:
            memo[symbol, at] = frozenset(e for parts in self.rules[symbol] for e in self._sequence(parts, at, tokens, memo))
        return memo[symbol, at]

    def _sequence(self, parts: list[str], at: int, tokens: list[str], memo: dict) -> set[int]:
        reached = {at}
        for part in parts:
            if part[0] == "~":
                for e in list(reached):
                    for k in range(e, min(len(tokens), e + int(part[1:]))):
                        if tokens[k] in _SENTENCE_END:
                            break
                        reached.add(k + 1)
            else:
                after = {e for r in reached for e in self.ends(part.rstrip("?"), r, tokens, memo)}
                reached = reached | after if part[-1] == "?" else after
            if not reached:
                break
        return reached

    def found(self, symbol: str, tokens: list[str]) -> bool:
        memo: dict = {}
        return any(self.ends(symbol, i, tokens, memo) for i in range(len(tokens)))


_REFUSALS = Grammar(_GRAMMAR)


def is_refusal(answer: str) -> bool:
    text = answer.lower().replace("’", "'")
    tokens = re.findall(r"[^\W_]+(?:'[^\W_]+)*|[.!?;]", _CONTRACTED.sub(_in_full, text))
    return not _TRIGGERS.isdisjoint(tokens) and _REFUSALS.found("REFUSAL", tokens)


# --- languages ------------------------------------------------------------

#: Function words of the languages told apart (fixed values).
_FUNCTION_WORDS = {
    "en": "a the of and to in is are was were be for on with that this it by from or not if when which what how why who does do can must should as at an any each no yes only you your than under within after before will has have had its both there nothing until unless",
    "es": "el la los las de del que y en un una es son para por con no se su al lo como más si cuando debe sí puede antes después este esta sobre durante usted",
    "fr": "le la les des du de et en un une est sont pour par avec ne pas se sa son au aux ce cette que qui dans si lorsque doit peut oui vous comment plus avant seulement être sur pendant",
    "de": "der die das den dem des und in ein eine einer ist sind für mit nicht auf von zu im wenn oder wird werden kann muss nach als auch nur bei ja wie noch vor wird sie aus",
    "pt": "o a os as de do da dos das que e em um uma é são para por com não se sua ao no na como mais quando deve sim pode antes depois este esta sobre durante você",
    "it": "il lo la gli le di del della che e in un una è sono per con non si sua al come più quando deve sì può prima dopo questo questa su durante",
    "nl": "de het een van en in is zijn voor met niet op te als of wordt worden kan moet na ook bij ja hoe nog dat die aan",
    "vi": "và của là có được cho các không khi này một trong với người phải nếu hãy chỉ đã năm khoản tháng",
    "pl": "i w na z do nie że się jest to dla po od przez jak oraz lub może musi przed rok",
}
_FUNCTION_WORDS = {k: frozenset(v.split()) for k, v in _FUNCTION_WORDS.items()}
_LETTERS = {"es": "ñ¿¡", "fr": "çœêèàù", "de": "ßäöü", "pt": "ãõ", "vi": "ăđơưạảấầẩậắằẵặẹẻẽếềểễệịỉọỏốồổộớờởỡợụủứừửữựỳỵỷỹ", "pl": "ąęłńśźż"}
_SCRIPTS = (
    ("ru", re.compile(r"[Ѐ-ӿ]")), ("zh", re.compile(r"[一-鿿]")), ("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯]")),
    ("ar", re.compile(r"[؀-ۿ]")), ("he", re.compile(r"[֐-׿]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("th", re.compile(r"[฀-๿]")),
)
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»")
_NAMES = re.compile(r"\b(?:form|schedule|publication|pub\.|sch\.|irs|line)\s+\w[\w-]*", re.I)
_LEAD = re.compile(r"^\s*\w+(?:\s\w+)?\s*:\s*")


def language(text: str) -> tuple[str | None, int]:
    """(language, words that say so); (None, 0) if nothing tells it."""
    core = _NAMES.sub(" ", _QUOTED.sub(" ", _LEAD.sub("", text)))
    if core.isascii():
        return _by_words(re.findall("[a-z]+", core.lower()))
    latin = len(re.findall(r"[A-Za-zÀ-ɏḀ-ỿ]", core))
    for name, pattern in _SCRIPTS:
        count = len(pattern.findall(core))
        if count > 2 and count * (3 if name in ("zh", "ja", "ko") else 1) > latin:
            return ("ja", count) if name == "zh" and re.search(r"[぀-ヿ]", core) else (name, count)
    return _by_words(re.findall(r"[^\W\d_]+", core.lower()))


@lru_cache(maxsize=100_000)
def _votes(word: str) -> tuple[str, ...]:
    """The languages that a word speaks for, by being a function word and by its letters."""
    return (*(k for k, v in _FUNCTION_WORDS.items() if word in v), *(k for k, letters in _LETTERS.items() if any(c in letters for c in word)))


def _by_words(words: list[str]) -> tuple[str | None, int]:
    votes = dict.fromkeys(_FUNCTION_WORDS, 0)
    for w in words:
        for k in _votes(w):
            votes[k] += 1
    best = max(votes, key=lambda k: (votes[k], k == "en"))
    return (best, votes[best]) if votes[best] else (None, 0)


def other_language(question: str, answer: str) -> bool:
    asked, n = language(question)
    said, m = language(answer)
    if not asked or not said or asked == said or n < 2 or m < 2:
        return False
    words = re.findall(r"[^\W\d_]+", _NAMES.sub(" ", _QUOTED.sub(" ", answer)).lower())
    ours = sum(w in _FUNCTION_WORDS.get(asked, ()) for w in words)
    return m > ours


# --- copies ---------------------------------------------------------------

_INTRODUCTIONS = frozenset("you asked ask asking want wanted to know the question is was your about i understand that as thank for well so regarding here following answer response a q answering pregunta preguntó usted la question est".split())
_DECISIONS = frozenset("no not yes cannot can't never none nothing only because since unless sí oui nein ja".split())
_COPY_WORD = re.compile(r"[^\W_]+(?:[.,'’-][^\W_]+)*")


def tiles(a: list[str], b: list[str], least: int = 2) -> list[tuple[int, int, int]]:
    """Greedy string tiling: longest common runs first, no token twice; (start in a, start in b, length)."""
    used_a, used_b, found = [False] * len(a), [False] * len(b), []
    where = defaultdict(list)
    for j, w in enumerate(b):
        where[w].append(j)
    while True:
        longest, best = least, []
        for i, w in enumerate(a):
            if used_a[i]:
                continue
            for j in where.get(w, ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > longest or k == longest and not best:
                    longest, best = k, [(i, j, k)]
                elif k == longest:
                    best.append((i, j, k))
        if not best:
            return found
        for i, j, k in best:
            if not any(used_a[i : i + k]) and not any(used_b[j : j + k]):
                used_a[i : i + k] = used_b[j : j + k] = [True] * k
                found.append((i, j, k))


def covered(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """The tokens of a and b in tiles. Of a text that repeats the other several times every repetition is tiled."""
    in_a, in_b = set(), set()
    step = 2 * len(b) + 20
    if len(a) <= step:
        for i, j, k in tiles(a, b):
            in_a.update(range(i, i + k))
            in_b.update(range(j, j + k))
        return in_a, in_b
    where = defaultdict(list)
    for j, w in enumerate(b):
        where[w].append(j)
    i = 0
    while i < len(a):
        longest, at = 0, 0
        for j in where.get(a[i], ()):
            k = 1
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > longest:
                longest, at = k, j
        if longest >= 2:
            in_a.update(range(i, i + longest))
            in_b.update(range(at, at + longest))
        i += max(1, longest)
    return in_a, in_b


def is_copy(question: str, answer: str) -> bool:
    q = _COPY_WORD.findall(question.lower())
    known = set(q)
    a = _COPY_WORD.findall(answer.lower())
    if len(q) < 3 or len(a) < 3 or len(known.intersection(a)) < 0.5 * len(known):
        return False
    most = max(1, 0.2 * len(q))
    if sum(w not in known and w not in _INTRODUCTIONS for w in a) > most:  # they stay new however it is tiled
        return False
    in_a, in_q = covered(a, q)
    first = min(in_a, default=0)
    fresh = [w for i, w in enumerate(a) if i not in in_a and not (i < first and w in _INTRODUCTIONS)]
    new = [w for w in fresh if w not in known]
    if _DECISIONS & set(new):
        return False
    return len(in_q) >= 0.8 * len(q) and len(new) <= most and len(fresh) <= 0.35 * len(a)


# --- truncation -----------------------------------------------------------

_TOKEN = re.compile(r"```|</?[A-Za-z][^<>\n]*>|[(\[{]|[)\]}]|[\"“”«»]|(?:(?<=\s)|^)(?:\d{1,2}|[a-z])[.)](?=\s|$)|\$?\d(?:[\d.,]*\d)?(?:%|[A-Za-z]{1,3}\b)?|[^\W_]+(?:['’.-]+[^\W_]+)*|[^\w\s]")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_VOID = frozenset("br hr img input meta link".split())
_MARKER = re.compile(r"(?:\d{1,2}|[a-z])[.)]")
#: Closed classes of English words (fixed values).
_CLASSES = {
    "determiner": "the a an each every its their his her your our my this these those some any no whose",
    "preposition": "of in on at by for with without from to into onto under over between among through during within per about against toward towards upon across behind beyond above below beside besides despite than via as after before until since",
    "conjunction": "and or but nor plus",
    "auxiliary": "is are was were be been being am has have had do does did must may might can could will would shall should cannot",
    "subordinator": "if unless because when whenever while where wherever although though whether which that who whichever whatever provided",
    "pronoun": "it they them he she you we i there himself herself itself themselves",
    "adverb": "then finally also next otherwise instead even not only more less",
}
_CLASS = {w: k for k, v in _CLASSES.items() for w in v.split()}
_JOINS = frozenset(("preposition", "conjunction", "auxiliary", "subordinator"))
_STOPS = frozenset(".!?")
_DANGLING = frozenset(",;:-–—/&($")
_FINAL = re.compile(r"[.!?。！？।]['\"”’»)\]]*$")
_NEEDS = ("noun", "follower", "conjunct", "complement", "clause", "verb")


class Words:
    """How words behave in all answers: n, times followed by something; ends, of these before the end of a phrase; bare, times an answer without a final mark ends with it."""

    def __init__(self, counts: dict[str, tuple[int, int, int]]):
        self.counts = counts
        self.names = sorted(counts)
        self.sums = [0, *accumulate(counts[w][0] for w in self.names)]
        self.more: dict[str, tuple[int, int, int]] = {}

    def look_up(self, more: dict[str, tuple[int, int, int]]) -> None:
        """The words beyond `counts` that the next answer needs."""
        self.more = more

    def of(self, word: str) -> tuple[int, int, int]:
        return self.counts.get(word) or self.more.get(word, (0, 0, 0))

    def begun(self, prefix: str) -> int:
        """Occurrences of longer words with this beginning."""
        low, high = bisect_left(self.names, prefix), bisect_left(self.names, prefix + "\U0010ffff")
        return self.sums[high] - self.sums[low] + sum(c[0] for w, c in self.more.items() if w.startswith(prefix)) - self.of(prefix)[0]

    def needs_follower(self, word: str) -> bool:
        n, ends, _ = self.of(word)
        return n >= 5 and ends < 0.05 * n

    def may_end(self, word: str) -> bool:
        """Whether answers often end with the word, be it one that opens a phrase."""
        n, _, bare = self.of(word)
        return bare - 1 >= 0.05 * (n + bare)

    def cut(self, word: str) -> bool:
        """Whether it is the beginning of a word and no word."""
        n, _, bare = self.of(word)
        if len(word) < 2 or not word.isalpha():
            return False
        longer = self.begun(word)
        return n <= 1 + 0.001 * longer and longer > (4 if bare <= 2 else 6) * (n + bare)


def units(text: str) -> list[str]:
    return _TOKEN.findall(text)


def left_open(text: str, words: Words | None = None) -> list[str]:
    """What a pushdown parse of the text leaves open at its end, outermost first; phrases only if `words` is given."""
    stack: list[str] = []
    found = units(text)
    items, dangling, fresh = 0, False, True

    def close(*kinds: str) -> None:
        while stack and stack[-1] in kinds:
            stack.pop()

    def shut(opener: str) -> None:
        if opener in stack:
            while stack.pop() != opener:
                pass

    for at, t in enumerate(found):
        dangling = False
        inside = bool(stack) and stack[-1] == "```"
        if t == "```":
            stack.pop() if inside else stack.append(t)
        elif inside:
            continue
        elif _MARKER.fullmatch(t) and t[:-1] in (str(items + 1), chr(97 + items)):
            close(*_NEEDS)
            items, dangling, fresh = items + 1, True, True
        elif t in "([{“«":
            stack.append(t)
        elif t in _PAIRS:
            shut(_PAIRS[t])
            close("noun", "follower", "conjunct", "complement")
        elif t == '"':
            if '"' in stack:
                shut('"')
                close("noun", "follower", "conjunct", "complement")
            else:
                stack.append(t)
        elif t[0] == "<" and len(t) > 2:
            name = re.match(r"</?(\w+)", t).group(1).lower()
            if t[1] == "/":
                shut(f"<{name}")
            elif name not in _VOID and not t.endswith("/>"):
                stack.append(f"<{name}")
        elif words is None:
            continue
        elif t in _STOPS:
            close(*_NEEDS)
            fresh = True
        elif not (t[0].isalnum() or t[0] == "$"):
            if t in _DANGLING:
                close("noun", "follower")
                if at == len(found) - 1:
                    stack.append("follower")
        else:
            _phrase(t, stack, close, words, fresh, at == len(found) - 1)
            fresh = False
    if items > 1 and dangling:
        stack.append("item")
    return stack


def _phrase(t: str, stack: list[str], close, words: Words, fresh: bool, last: bool) -> None:
    """One word or number within a sentence."""
    word = t.lower()
    kind = _CLASS.get(word)
    top = stack[-1] if stack else ""
    if t == "$":
        stack.append("noun")
    elif t[0] in "$0123456789":
        close("noun", "follower", "conjunct", "complement")
        if stack and stack[-1] == "clause":
            stack[-1] = "verb"
    elif kind is None and last and words.cut(word):
        stack.append("follower")
    elif last and words.may_end(word):
        close("noun", "follower", "conjunct", "complement", "verb", "clause")
    elif word == "no" and fresh and last:  # an answer
        return
    elif kind in ("determiner", "preposition"):
        if top == "verb" and kind == "preposition":  # what a noun was taken for may have been the verb
            stack.pop()
        if top != "noun":
            stack.append("noun")
    elif kind == "conjunction":
        close("noun", "follower")
        stack.append("conjunct")
    elif kind == "auxiliary":
        close("noun", "follower", "conjunct", "verb", "clause")
        stack.append("complement")
    elif kind == "subordinator":
        close("noun", "follower", "conjunct", "complement")
        stack.append("clause")
    elif kind == "adverb":
        if fresh or last and word not in ("more", "less", "only", "instead"):
            stack.append("follower")
    elif kind != "pronoun" and words.needs_follower(word):
        if top == "verb":
            stack.pop()
        if top not in ("noun", "follower"):
            stack.append("follower")
    else:
        named = top in ("noun", "follower", "clause") or kind == "pronoun"
        close("noun", "follower", "conjunct", "complement")
        if stack and stack[-1] == "verb" and not named:
            stack.pop()
        elif stack and stack[-1] == "clause":
            stack[-1] = "verb"


_ELLIPSIS = re.compile(r"(?:\.\.\.|…|\[\.\.\.\]|\[…\]|\[truncated\]|\(continued\))['\"”)\]]*$")
_STRUCTURE = re.compile(r"[(\[{\"“«<`]|\b[0-9a-z][.)](?:\s|$)")


def is_truncated(answer: str, words: Words) -> bool:
    text = _INVISIBLE.sub(" ", answer).strip()
    if _ELLIPSIS.search(text):
        return True
    finished = bool(_FINAL.search(text))
    if finished and not _STRUCTURE.search(text):
        return False
    return bool(left_open(text, None if finished else words))


def word_counts(texts) -> dict[str, list[int]]:
    """n, ends and bare of the words of some answers (see Words)."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for text in texts:
        found = [t.lower() for t in units(_INVISIBLE.sub(" ", text).strip())]
        for t, after in zip(found, found[1:]):
            if t[0].isalpha():
                row = counts[t]
                row[0] += 1
                row[1] += not (after[0].isalnum() or after[0] in "$(\"“«") or _CLASS.get(after) in _JOINS
        if found and found[-1][0].isalpha():
            counts[found[-1]][2] += 1
    return counts


# --- all -------------------------------------------------------------------


def defect(question: str | None, answer: str | None, words: Words) -> str | None:
    if is_empty(answer):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    if question and is_copy(question, answer):
        return "copied"
    if question and other_language(question, answer):
        return "language"
    return "truncated" if is_truncated(answer, words) else None


def _counter(batches):
    total: dict[str, list[int]] = {}

    def flush():
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([total[k][i] for k in keys], pa.int64()) for i in range(3)]], names=["word", "n", "ends", "bare"])
        total.clear()

    for batch in batches:
        for w, c in word_counts(t for t in batch.column(0).to_pylist() if t).items():
            row = total.setdefault(w, [0, 0, 0])
            for i in range(3):
                row[i] += c[i]
        if len(total) > 500_000:
            yield from flush()
    yield from flush()


def _unfinished(answer: str | None) -> list[str]:
    """The words of an answer without a final mark, the last one last; they are looked up."""
    text = _INVISIBLE.sub(" ", answer or "").strip()
    return [t.lower() for t in units(text) if t[0].isalpha()] if text and not _FINAL.search(text) else []


def _asker(shared):
    """qa_id, key, whole: the words beyond the broadcast ones that an answer needs, and the last one as a beginning."""

    def ask(batches):
        known = shared.value
        for batch in batches:
            ids, keys, whole = [], [], []
            for i, a in enumerate(batch.column(2).to_pylist()):
                found = _unfinished(a)
                asked = {(w, True) for w in found if w not in known} | ({(found[-1], False)} if found else set())
                for w, exact in sorted(asked):
                    ids.append(i)
                    keys.append(w)
                    whole.append(exact)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(keys, pa.string()), pa.array(whole, pa.bool_())], names=["qa_id", "key", "whole"])

    return ask


def _finder(shared):
    def find(batches):
        words = Words(shared.value)
        for batch in batches:
            more = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            found = []
            for q, a, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), more):
                words.look_up({r["word"]: (r["n"], r["ends"], r["bare"]) for r in rows or ()})
                found.append(defect(q, a, words))
            at = [i for i, d in enumerate(found) if d]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([found[i] for i in at], pa.string())], names=["qa_id", "defect"])

    return find


def defective_pairs(pairs: DataFrame, id_col: str = "qa_id", question_col: str = "question", answer_col: str = "answer", lexicon: int = LEXICON) -> DataFrame:
    """qa_id, defect of every defective pair.

    Words are counted over the answers of all ids. `lexicon` (1 or more) is how
    many of them are broadcast and has no effect on the result.
    """
    rows = pairs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("qa_id"), F.col(question_col).alias("_q"), F.col(answer_col).alias("_a"))
    single = rows.groupBy("qa_id").agg(F.min(F.struct("_q", "_a")).alias("_r")).select("qa_id", "_r._q", "_r._a")
    told = single.select("_a").where("_a is not null").mapInArrow(_counter, "word string, n long, ends long, bare long")
    counts = durable(told.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "ends", "bare")]))
    top = counts.orderBy(F.desc("n"), "word").limit(lexicon + 1).toArrow()
    known = top.slice(0, lexicon).to_pylist()
    shared = pairs.sparkSession.sparkContext.broadcast({r["word"]: (r["n"], r["ends"], r["bare"]) for r in known})
    kind = dict(rows.dtypes)["qa_id"]
    if top.num_rows > lexicon:
        single = durable(single)
        last = known[-1]
        beyond = counts.where((F.col("n") < last["n"]) | (F.col("n") == last["n"]) & (F.col("word") > last["word"]))
        starts = beyond.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.substring("word", F.lit(1), k))).alias("key"))
        asked = single.mapInArrow(_asker(shared), f"qa_id {kind}, key string, whole boolean")
        met = asked.join(starts, "key").where(~F.col("whole") | (F.col("key") == F.col("word"))).groupBy("qa_id").agg(F.collect_set(F.struct("word", "n", "ends", "bare")).alias("_more"))
        single = single.join(met, "qa_id", "left")
    return single.mapInArrow(_finder(shared), f"qa_id {kind}, defect string")
