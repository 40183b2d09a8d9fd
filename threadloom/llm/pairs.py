"""Question and answer pairs with a defect: empty, copy, refusal, other language, truncated.

Copies are found by compressing the answer with the question as a zstandard dictionary: an answer that
is nothing but its question costs almost nothing; what is left over is then checked word by word.
Refusals and languages come from dictionaries, truncation from a terminal-context model: how often the
corpus goes on after the last words of an answer, and how often it stops.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.blank import blank

#: Compressed size, as a share of the answer plus a constant, up to which an answer may be a copy.
COPY_SHARE, COPY_BYTES = 0.12, 40
#: One word in so many may be changed, put in or left out in a copy of a question; and the bytes that each may cost.
COPY_WORDS, WORD_BYTES = 12, 10
#: Pieces of the question, and their length, of which a copy of it holds one.
PROBES, PROBE_CHARS = 8, 12
#: Words of a terminal context, and the share (one in so many answers) from which an unpunctuated ending is usual.
CONTEXT, FINAL_SHARE = 4, 1_000
#: Words back, from the last, of the wider context that decides where the near one is rare.
FAR = (8, 5)

_NOISE = re.compile(r"[\W_]+")
_WORDS = re.compile(r"[^\W\d_]+")
# Words that may introduce a repeated question (canonical form, longest first when cut).
_INTRO = frozenset(
    "you asked your question is was the q question quote here again as said i understand so sure ok okay repeat prompt user message input original request"
    " du hast gefragt sie haben ihre deine frage war ist zitat nochmal anfrage"
    " vous avez demandé tu as votre ta est voici la citation demande je répète"
    " preguntaste usted preguntó tu su pregunta es era cita aquí está la de nuevo".split()
)
# Function words of the four languages.
LANGUAGES = {
    "en": frozenset("the and of to is in that for it was with on as are this not be have from but by or at an its than they when where which were so only each has because both would can you me my we what how why do does did i please about after before into once instead because if your there these their could should while between against through here most same then".split()),
    "de": frozenset("der die das und ist nicht ein eine den von zu mit auf für im dem des sich als auch werden wird es an bei aus nach weil noch alle wie was warum wo kannst du dir mir ich hat haben sind wir bitte über um bis nur vorher waren mehr keine kein einem einer war dass wenn ob oder aber seit danach dann gestern heute zum zur ihn sie".split()),
    "fr": frozenset("le la les des et est une un du pour dans que qui ne pas sur au avec ce sont par plus nous il qu été cette en ou à ses se mais où depuis pourquoi peux tu puis je son moi dire aussi elle ont ai au lieu quand comment combien faut sans aux c d l s n j car dès tant ensuite".split()),
    "es": frozenset("el la los las de y que en un una es no se por con para del al lo como más pero sus fue este cada su ya ha cuando desde dónde qué cuánto está son hay le antes sin todavía otra vez porque puedes puedo si también sobre mientras nada así entre hasta nadie después".split()),
}
# How a question asks for a language of the answer.
_ASKS = {
    "en": re.compile(r"\b(?:in|into|auf|en|al|to)\s+(?:english|englisch|anglais|inglés|ingles)\b", re.I),
    "de": re.compile(r"\b(?:in|into|auf|en|al|to)\s+(?:german|deutsch|allemand|alemán|aleman)\b", re.I),
    "fr": re.compile(r"\b(?:in|into|auf|en|al|to)\s+(?:french|französisch|francais|français|francés|frances)\b", re.I),
    "es": re.compile(r"\b(?:in|into|auf|en|al|to)\s+(?:spanish|spanisch|espagnol|español|espanol|castellano)\b", re.I),
}
_ASKS_ANY = re.compile(r"\b(?:translate|translation|übersetz\w*|tradui\w*|traducción|traduc\w+)\b", re.I)
# What a sentence that only declines says.
_REFUSAL = re.compile(
    r"can(?:'|’)?t help|cannot help|can not help|unable to (?:help|assist|answer|carry out|provide|comply|do)|not able to (?:help|assist|answer|do|comply|provide)|won(?:'|’)t be able to|cannot (?:provide|answer|assist|comply|do|fulfil)|can(?:'|’)?t (?:assist|answer|comply|do that|provide|discuss)"
    r"|feel comfortable|must (?:respectfully )?(?:decline|pass|refuse)|have to (?:decline|refuse|pass)|outside what i am allowed|off limits|against the guidelines|breach the usage policy|usage policy|as a(?:n ai| language) model|only an assistant|not going to do that|no permission|not have permission|not permitted|not allowed to"
    r"|told not to|nothing i can add|leave (?:it there|this one|unanswered)|unanswered for|for safety reasons|not be appropriate for me|would not be appropriate|i (?:decline|refuse)|not something i can"
    r"|kann ich (?:dir |ihnen )?(?:leider )?nicht|dabei kann ich|darf ich (?:leider )?nicht|nicht erlaubt|leider ablehnen|muss ich (?:\S+ )?ablehnen|lehne (?:ich|diese)|aus sicherheitsgründen|als sprachmodell|übernehme ich nicht|möchte ich mich|nicht äußern|bin nicht (?:befugt|in der lage)|nicht möglich,? (?:dir|ihnen|das)"
    r"|ne peux pas|ne puis|m'est pas permis|n'est pas permis|dois refuser|refuser cette demande|pas le droit|modèle de langue|raisons de sécurité|ne pas m'exprimer|ne suis pas en mesure|ne m'en (?:occuperai|chargerai)|préfère ne pas|pas autorisé"
    r"|no puedo|no me está permitido|no está permitido|tengo que rechazar|debo rechazar|modelo de lenguaje|no tengo permiso|razones de seguridad|motivos de seguridad|no me voy a encargar|prefiero no|no estoy (?:autorizado|en condiciones)|no es posible para mí"
)
# Courtesies that may stand beside a refusal without answering anything.
_COURTESY = re.compile(r"another question|anything else|happy to (?:take|help)|please ask someone|ask someone|thanks? (?:you )?for asking|sorry|apolog|unfortunately|wende dich|frag bitte|andere frage|leider|tut mir leid|entschuldig|désolé|autre question|adressez|adresse-toi|demandez|demande à quelqu|lo siento|otra pregunta|pregunta a quien|disculp|lamento")
_SENTENCE = re.compile(r"[^.!?;\n]+(?:[.!?](?=\S)[^.!?;\n]*)*")
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TECHNICAL = re.compile(r"\S*[/_\d@#()=<>{}\\]\S*|\b\w*[a-zß-ÿ][A-ZÀ-Þ]\w*|\b\w+-\w+(?:-\w+)*\b|`[^`\n]*`")


#: The same for texts of one byte a character: what is deleted, and a table that leaves only letters apart from blanks.
_DELETED = bytes(c for c in range(256) if _NOISE.match(chr(c)))
_BLANKED = bytes(c if _WORDS.match(chr(c)) else 32 for c in range(256))


def canonical(text: str) -> str:
    """Letters and digits in lower case."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(None, _DELETED).decode("latin-1")
    except UnicodeEncodeError:
        return _NOISE.sub("", text)


def _words(text: str) -> list[bytes]:
    """The runs of letters in lower case, as bytes; letters outside one byte become question marks."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_BLANKED).split()
    except UnicodeEncodeError:
        return [w.encode("latin-1", "replace") for w in _WORDS.findall(text)]


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer, without dress, is its question once or more, at most with introducing or a few changed words.

    The answer is compressed with the question as a zstandard dictionary; where that leaves little, the words
    that the compression could not take from the question are looked at.
    """
    if 3 * len(answer) < len(question):
        return canonical(question) == canonical(answer) != ""  # far too short, unless the question is mostly dress
    q, a = canonical(question), canonical(answer)
    if not q or not a:
        return False
    if q == a:
        return True
    if len(q) < 8:
        return len(q) >= 3 and not a.replace(q, "")
    if len(a) < 0.9 * len(q) or not any(q[at : at + PROBE_CHARS] in a for at in range(0, len(q), max(1, len(q) // PROBES))):
        return False
    changed, introduced, words = _left_words(question, answer)
    allowed = words // COPY_WORDS
    if changed > allowed:
        return False
    raw = q.encode()
    own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = len(zstandard.ZstdCompressor(level=1, dict_data=own).compress(a.encode()))
    return size <= COPY_SHARE * len(raw) + COPY_BYTES + introduced + WORD_BYTES * 2 * changed


_INTRO_OF = frozenset(w.encode("latin-1") for w in _INTRO)


def _left_words(question: str, answer: str) -> tuple[int, int, int]:
    """(words put in or left out, letters of introducing words, words of the question), the question once or more often."""
    have, seen = Counter(_words(question)), Counter(_words(answer))
    total = sum(have.values())
    times = max(1, round(sum(min(n, seen[w]) if seen[w] <= n else seen[w] for w, n in have.items()) / max(1, total)))
    changed = introduced = 0
    for w in have.keys() | seen.keys():
        more = seen[w] - times * have[w]
        if more > 0 and w in _INTRO_OF:
            introduced += more * len(w)
        else:
            changed += abs(more)
    # a word exchanged for another is one change; so many are allowed for each time
    return -(-changed // (2 * times)) if changed else 0, introduced, total


def is_refusal(answer: str) -> bool:
    """Whether every sentence of the answer declines or is a courtesy, and one declines."""
    if "```" in answer:
        return False
    declined = False
    for m in _SENTENCE.finditer(answer.lower()):
        sentence = m.group()
        if not _WORDS.search(sentence):
            continue
        if _REFUSAL.search(sentence):
            declined = True
        elif not _COURTESY.search(sentence):
            return False
    return declined


_NAMES = tuple(LANGUAGES)
#: Function words, each with a one in the field of every language that has it: a text's words are summed in one number.
_FIELD = 32
_BIT = {w: sum((w in known) << (_FIELD * i) for i, known in enumerate(LANGUAGES.values())) for w in frozenset().union(*LANGUAGES.values())}
_BIT_OF = {w.encode("latin-1"): n for w, n in _BIT.items()}


def _tally(words: list[bytes]) -> list[int]:
    """Function words of each language."""
    whole = sum(map(_BIT_OF.__getitem__, filter(_BIT_OF.__contains__, words)))
    return [whole >> (_FIELD * i) & (1 << _FIELD) - 1 for i in range(len(_NAMES))]


def main_language(text: str) -> str | None:
    """The language whose function words clearly prevail in the whole text."""
    totals = _tally(_words(text))
    first, second = sorted(totals, reverse=True)[:2]
    return _NAMES[totals.index(first)] if first >= second + 2 else None


def languages_of(text: str) -> tuple[Counter, set[str]]:
    """Sentences by clear language, and every language that a sentence might be in."""
    clear: Counter = Counter()
    possible: set[str] = set()
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", _CODE.sub("\n", text)):
        words = _words(_TECHNICAL.sub(" ", sentence))
        scores = sorted(zip(_tally(words), _NAMES), reverse=True)
        if "¿" in sentence or "ñ" in sentence:
            scores = sorted(((s + 2 * (n == "es"), n) for s, n in scores), reverse=True)
        if "ß" in sentence:
            scores = sorted(((s + 2 * (n == "de"), n) for s, n in scores), reverse=True)
        best = scores[0][0]
        if best == 0:
            continue
        possible.update(n for s, n in scores if s >= best - 1 and s > 0)
        if best - scores[1][0] >= 2 or (best >= 1 and scores[1][0] == 0 and len(words) <= 6):
            clear[scores[0][1]] += 1
    return clear, possible


def is_other_language(question: str, answer: str) -> bool:
    """Whether the answer is wholly in a language that the question is not in and did not ask for."""
    first = main_language(answer)
    if first is not None and first == main_language(question) or _ASKS_ANY.search(question):
        return False  # most pairs end here
    asked, maybe_asked = languages_of(question)
    if first in maybe_asked:
        return False
    said, _ = languages_of(answer)
    if len(said) != 1:
        return False
    (language,) = said
    if language in maybe_asked or not asked or _ASKS[language].search(question):
        return False
    return sum(asked.values()) >= 1 and len(_WORDS.findall(_TECHNICAL.sub(" ", question))) >= 3


# -- truncation ---------------------------------------------------------------------------------------

_TOKEN = re.compile(r"`[^`\n]*`|\S+")
# Endings of file names.
_EXTENSIONS = frozenset(".md .py .go .ts .js .json .yaml .yml .toml .sql .txt .log .sh .css .html .csv .rs .java .c .h .cpp .rb .xml .ini .cfg .env".split())
_PATH = re.compile(r"[\w.\-]*/[\w./\-]*?(\.[a-z]{1,5})?$")
_END = re.compile(r"[.!?…]+[\"'”»)\]*_]*$")
_CLOSE = "\"'”»)]*_,;:"


_VERSION, _NUMERIC, _DATE, _HUMPED, _DIGITS = (re.compile(x) for x in (r"v\d+\.\d+\.\d+", r"[\d.,%]+", r"\d{4}-\d\d-\d\d\S*", r"[a-z][A-Z]", r"\d"))


@lru_cache(1 << 16)
def shape(token: str) -> str:
    """A word in lower case, or the class of a path, version, number, reference, identifier or call."""
    token = token.strip("\"'“”«»(),;:*_[]").rstrip(".!?…")
    if not token:
        return ""
    if "/" in token:
        m = _PATH.match(token)
        return ("<path>" if m.group(1) in _EXTENSIONS else "<path?>") if m else "<slash>"
    if _VERSION.fullmatch(token):
        return "<version>"
    if _NUMERIC.fullmatch(token):
        return "<number>"
    if _DATE.fullmatch(token):
        return "<date>"
    if _DIGITS.search(token):
        return "<reference>"
    if token.endswith("()"):
        return "<call>"
    if "_" in token or _HUMPED.search(token):
        return "<name>"
    if "-" in token:
        return "<dashed>"
    return token.lower()


def _parts(token: str) -> list[str]:
    return [p.lower() for p in re.findall(r"[A-ZÀ-Þ]?[a-zß-ÿ]+|[A-ZÀ-Þ]+", token)]


def last_context(text: str) -> tuple[tuple[str, ...], str] | None:
    """(shapes of the last words of the last line, last raw token); ``^`` stands for the line's start."""
    shapes: list[str] = []
    last = None
    for token in reversed(_TOKEN.findall(text.rsplit("\n", 1)[-1])):
        form = shape(token)
        if not form:
            continue
        if last is None:
            last = token
        elif len(shapes) == FAR[0] or _END.search(token):
            break  # far enough, or the sentence before
        shapes.append(form)
    return ((*["^"] * (FAR[0] - len(shapes)), *reversed(shapes)), last) if last is not None else None


def ending(text: str) -> bool | tuple[tuple[str, ...], str]:
    """Whether a text is cut off, or where only the counts can tell, its last context."""
    tail = text.rstrip()
    if tail.count("```") % 2:
        return True
    begin = tail.rfind("-----BEGIN ")
    if begin >= 0 and "-----END " not in tail[begin:]:
        return True
    if tail.endswith("```"):
        return False
    line = tail.rsplit("\n", 1)[-1].strip()
    if re.fullmatch(r"(?:[-*•]|\d+[.)])", line) or tail[-1] in ":,;-(" or tail[-1] in "–—/\\=":
        return not (tail[-1] == ";" and re.search(r"[=()]", line))
    if _END.search(tail):
        return False
    if tail[-1] in "\"'`)]}>”»|":
        opened = tail[-1] in ")]}" and line.count("(") + line.count("[") + line.count("{") < line.count(")") + line.count("]") + line.count("}")
        return opened
    if re.match(r"(?:\s{2,}|\t)[\w.\-]+:\s+\S+$", tail.rsplit("\n", 1)[-1]):
        return False  # the last entry of an indented block
    return last_context(tail) or False


def _asked(context: tuple[str, ...], raw: str) -> Iterator[tuple[str, tuple[str, ...]]]:
    """The counts that ``complete`` looks up for an ending."""
    for n in range(2, CONTEXT + 1):
        yield "near", context[-n:]
    yield "far", context[: -FAR[1] + 1]
    for part in _parts(raw)[-1:]:
        yield "part", (part,)


class _Forms(dict):
    """Token to number, with what the counts need of each token; made when a token is first seen."""

    def __init__(self, words: dict[str, int]) -> None:
        super().__init__()
        self.words = words
        self.form: list[str] = []
        self.number: list[int] = []
        self.stop: list[bool] = []

    def __missing__(self, token: str) -> int:
        form = shape.__wrapped__(token)
        self.form.append(form)
        self.number.append(self.words.get(form, 1))
        self.stop.append(bool(_END.search(token)) and not token.endswith(".."))
        self[token] = at = len(self) + 1
        return at


class _Keys:
    """Wanted contexts under exact integer codes, in the order of the codes, and how often each was found."""

    def __init__(self, codes: dict[tuple, int]) -> None:
        self.keys = sorted(codes, key=codes.__getitem__)
        self.place = {k: i for i, k in enumerate(self.keys)}
        self.codes = np.array([codes[k] for k in self.keys], dtype=np.int64)
        self.totals = np.zeros((2, len(self.keys)), dtype=np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, -1 for what is not wanted."""
        if not self.keys:
            return np.full(len(codes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.keys) - 1)
        return np.where(self.codes[at] == codes, at, -1)

    def add(self, *places: np.ndarray) -> None:
        for total, found in zip(self.totals, places):
            total += np.bincount(found[found >= 0], minlength=len(self.keys))

    def counts(self, which: int) -> Iterator[tuple[tuple, int]]:
        return ((self.keys[i], int(self.totals[which, i])) for i in np.flatnonzero(self.totals[which]).tolist())


#: Distinct tokens that a task remembers before it starts afresh.
MEMO_TOKENS = 200_000


def _count(batches: Iterable[list[str | None]], wanted: dict[str, set]) -> tuple[dict, dict, dict, dict, int]:
    """(ends, goes_on, parts, finals, answers) of all texts, of what is ``wanted``.

    Tokens become numbers of the wanted words, 0 for the start of a unit and 1 for any other word; places whose
    last two words, or whose wider context, may be wanted are found for all texts of a batch at once.
    """
    near, distant, asked_parts = wanted["near"], wanted["far"], {p for (p,) in wanted["part"]}
    words = {"^": 0}
    for w in sorted({w for key in (*near, *distant) for w in key} - {"^"}):
        words[w] = len(words) + 1
    size = len(words) + 2
    two = _Keys({k[-2:]: words[k[-2]] * size + words[k[-1]] for k in near})
    three = _Keys({k[-3:]: words[k[-3]] * len(two) + two.place[k[-2:]] for k in near if len(k) >= 3})
    four = _Keys({k: words[k[0]] * len(three) + three.place[k[1:]] for k in near if len(k) == 4})
    half = _Keys({k[:2]: words[k[0]] * size + words[k[1]] for k in distant})
    far = _Keys({("far", *k): (half.place[k[:2]] * size + words[k[2]]) * size + words[k[3]] for k in distant})
    parts, finals, rows = Counter(), Counter(), 0
    memo = _Forms(words)
    for batch in batches:
        if len(memo) > MEMO_TOKENS:
            memo = _Forms(words)
        tokens: list[int] = []
        lengths: list[int] = []
        closing: list[bool] = []
        raw: Counter = Counter()
        for text in batch:
            if not text or blank(text):
                continue
            rows += 1
            lines = [line for line in (_CODE.sub("\n", text) if "```" in text else text).split("\n") if line.strip()]
            for line in lines:
                own = _TOKEN.findall(line)
                raw.update(own)
                tokens += [memo[t] for t in own]
                lengths.append(len(own))
                closing.append(False)
            if lines:
                closing[-1] = True
        if not tokens:
            continue
        ids = np.array(tokens, dtype=np.int64) - 1
        line = np.repeat(np.arange(len(lengths)), lengths)
        formed = np.array([bool(f) for f in memo.form])[ids]
        ids, line = ids[formed], line[formed]
        number, stop = np.array(memo.number, dtype=np.int64)[ids], np.array(memo.stop)[ids]
        n = len(ids)
        last = np.append(line[1:] != line[:-1], True) if n else np.zeros(0, dtype=bool)
        begins = np.append(True, last[:-1] | stop[:-1])[:n]
        place = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))  # words before it in its unit
        back = lambda j: np.where(place >= j, np.roll(number, j), 0)
        final = last & np.array(closing)[line] & ~stop  # the text stops here, whole or cut: the counts will tell
        ended = stop | last
        pair = two.find(back(1) * size + number)
        finals.update(pair[final & (pair >= 0)].tolist())
        triple = three.find(np.where(pair >= 0, back(2) * len(two) + pair, -1))
        begin = half.find(back(7) * size + back(6))
        for keys, found in ((two, pair), (three, triple), (four, four.find(np.where(triple >= 0, back(3) * len(three) + triple, -1))), (far, far.find(np.where(begin >= 0, (begin * size + back(5)) * size + back(4), -1)))):
            keys.add(found[~final & ended], found[~final & ~ended])
        names = {at - 1: token for token, at in memo.items()}
        for i in ids[final].tolist():
            raw[names[i]] -= 1
        for token, times in raw.items():
            if times and memo.form[memo[token] - 1]:
                for part in _parts(token):
                    if part in asked_parts:
                        parts[part] += times
    ends, goes_on = ({k: n for keys in (two, three, four, far) for k, n in keys.counts(i)} for i in (0, 1))
    return ends, goes_on, dict(parts), {two.keys[i]: n for i, n in finals.items()}, rows


def _endings(texts: Iterable[str | None]) -> dict[str, set]:
    """The counts that the unpunctuated endings of texts ask for."""
    wanted: dict[str, set] = {"near": set(), "far": set(), "part": set()}
    for text in texts:
        if not blank(text) and not isinstance(end := ending(text), bool):
            for kind, key in _asked(*end):
                wanted[kind].add(key)
    return wanted


class TerminalModel:
    """How often the last words of a unit are its end, and how often it goes on, by contexts of 4 to 2 words."""

    def __init__(self, ends: dict, goes_on: dict, parts: dict, finals: dict, rows: int) -> None:
        self.ends, self.goes_on, self.parts, self.finals, self.rows = ends, goes_on, parts, finals, rows

    @classmethod
    def fit(cls, texts: list[str | None]) -> TerminalModel:
        return cls(*_count([texts], _endings(texts)))

    def complete(self, context: tuple[str, ...], raw: str) -> bool:
        """Whether a text may end with these words and no full stop: the longest context that was seen decides."""
        pair = context[-2:]
        if self.finals.get(pair, 0) >= max(3, self.rows // FINAL_SHARE) and pair[-1] not in _BIT and self.goes_on.get(pair, 0) < self.finals[pair]:
            return True
        if not all(self.parts.get(p, 0) >= 2 for p in _parts(raw)[-1:]) and pair[-1] != "<reference>":
            return False
        if context[-3] == "^" and pair[-1] in ("<path>", "<version>", "<reference>"):
            return True  # a unit of its own such as: see PATH
        far = ("far", *context[: -FAR[1] + 1])
        if self.ends.get(far, 0) >= max(3, 4 * self.goes_on.get(far, 0)):
            return True
        for near in (context[-CONTEXT:], far, context[-3:], pair):
            on, end = self.goes_on.get(near, 0), self.ends.get(near, 0)
            if on + end >= 2:
                return end >= on
        return False

    def is_truncated(self, text: str) -> bool:
        end = ending(text)
        return end if isinstance(end, bool) else not self.complete(*end)


def fit_terminal_model(df: DataFrame, column: str) -> TerminalModel:
    """The model of all answers, with the counts that an unpunctuated ending among them asks for.

    The first pass finds those endings, the second counts them over every answer, added up in each
    task before the shuffle. What is sent grows with the distinct unpunctuated endings only.
    """
    held = df.select(F.col(column).alias("a")).filter("a IS NOT NULL")

    def endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(kind, "\n".join(key)) for kind, keys in _endings(batch["a"].tolist()).items() for key in sorted(keys)]
            yield pd.DataFrame(found, columns=["kind", "key"])

    wanted: dict[str, set] = {"near": set(), "far": set(), "part": set()}
    for r in held.mapInPandas(endings, "kind string, key string").distinct().toLocalIterator():
        wanted[r.kind].add(tuple(r.key.split("\n")))
    sent = df.sparkSession.sparkContext.broadcast(wanted)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, goes_on, parts, finals, rows = _count((b["a"].tolist() for b in batches), sent.value)
        found = [(kind, "\n".join(key), n) for kind, counter in (("ends", ends), ("goes_on", goes_on), ("finals", finals)) for key, n in counter.items()]
        yield pd.DataFrame([*found, *(("parts", p, n) for p, n in parts.items()), ("rows", "", rows)], columns=["kind", "key", "n"])

    model: dict[str, dict] = {"ends": {}, "goes_on": {}, "parts": {}, "finals": {}, "rows": {}}
    for r in held.mapInPandas(counts, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")).toLocalIterator():
        model[r.kind][r.key if r.kind == "parts" else tuple(r.key.split("\n"))] = r.n
    return TerminalModel(model["ends"], model["goes_on"], model["parts"], model["finals"], sum(model["rows"].values()))


def defect(question: str | None, answer: str | None, model: TerminalModel) -> str | None:
    """The defect of a pair whose question is not blank; None for a sound pair."""
    if blank(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    if model.is_truncated(answer):
        return "truncated"
    if is_other_language(question, answer):
        return "other_language"
    return None


def defective_pairs(df: DataFrame, key: str, question: str, answer: str, model: TerminalModel) -> DataFrame:
    """``(key, defect)`` of every row with a defect. Rows whose question is blank are left out; repeated rows are repeated."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # grows with the distinct unpunctuated endings

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (k, kind) for k, q, a in zip(batch["k"].tolist(), batch["q"].tolist(), batch["a"].tolist()) if not blank(q) and (kind := defect(q, a, sent.value))
            ]
            yield pd.DataFrame(found, columns=[key, "defect"])

    return df.select(F.col(key).alias("k"), F.col(question).alias("q"), F.col(answer).alias("a")).filter("q IS NOT NULL").mapInPandas(run, f"`{key}` bigint, defect string")
