"""Text helpers of the archive as Column expressions: folding, tokens, search terms, excerpts, labels, redaction."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that search treats as their plain form.
FOLD_FROM, FOLD_TO = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿ", "aaaaaaa" + "eeeee" + "iiiii" + "oooooo" + "uuuuu" + "n" + "c" + "yy"

#: What separates tokens: anything but letters, numbers and private-use characters.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
#: Characters of a text field that a result shows by default.
TEXT_BUDGET = 500
#: Words of a question that become search terms at most.
TERM_WORDS = 8


#: A letter or digit, for patterns of Spark and of SQL alike.
SEEN = r"[\p{L}\p{N}]"


def fold(text: Column | str) -> Column:
    """Lower case without diacritics; null stays null."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))


def tokens(text: Column | str) -> Column:
    """Folded tokens in order, an empty array for null or wordless text."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def term_words(question: str) -> list[str]:
    """Search words of a question: at least three bytes, not digits only, each once, the first TERM_WORDS."""
    found = re.findall(r"[^\W_]+", fold_text(question))
    return list(dict.fromkeys(w for w in found if len(w.encode()) >= 3 and not w.isdigit()))[:TERM_WORDS]


def search_term(question: str) -> str:
    return "+".join(term_words(question))


def search_term_col(text: Column | str) -> Column:
    """``search_term`` for a column."""
    words = F.filter(tokens(text), lambda w: (F.octet_length(w) >= 3) & ~w.rlike("^[0-9]+$"))
    return F.array_join(F.slice(F.array_distinct(words), 1, TERM_WORDS), "+")


def like_pattern(word: str) -> str:
    """A word as a substring LIKE pattern with its wildcards escaped."""
    return "%" + re.sub(r"([%_\\])", r"\\\1", word) + "%"


def contains_like(text: Column | str, word: str) -> Column:
    """Case-insensitive substring match of a word or of its unaccented form."""
    text = F.col(text) if isinstance(text, str) else text
    plain = fold_text(word)
    hit = text.ilike(like_pattern(word))
    return hit | fold(text).like(like_pattern(plain))


def like_all(text: Column | str, words: list[str]) -> Column:
    return _combine(text, words, lambda a, b: a & b)


def like_any(text: Column | str, words: list[str]) -> Column:
    return _combine(text, words, lambda a, b: a | b)


def _combine(text: Column | str, words: list[str], how) -> Column:
    out = None
    for word in words:
        hit = contains_like(text, word)
        out = hit if out is None else how(out, hit)
    return F.lit(False) if out is None else out


def or_unknown(part: Column | str) -> Column:
    return F.coalesce(F.nullif(F.trim(part), F.lit("")), F.lit("unknown"))


def author(agent: Column | str, model: Column | str, surface: Column | str) -> Column:
    """``agent/model via surface``; blank parts read unknown."""
    return F.concat(or_unknown(agent), F.lit("/"), or_unknown(model), F.lit(" via "), or_unknown(surface))


def clip(text: Column | str, budget: int) -> Column:
    return F.substring(text, 1, budget)


def excerpt(text: Column | str, word: str, budget: int = TEXT_BUDGET) -> Column:
    """A text within a budget: whole if it fits, else its head, an ellipsis and a window around the first match."""
    text = F.col(text) if isinstance(text, str) else text
    at = F.instr(fold(text), fold_text(word))
    half = budget // 2
    head = F.substring(text, 1, half)
    window = F.substring(text, F.greatest(at - F.lit(half // 2), F.lit(half + 1)), F.lit(half))
    return F.when(F.length(text) <= budget, text).when(at <= half, F.concat(F.substring(text, 1, budget), F.lit("…"))).otherwise(F.concat(head, F.lit(" … "), window))


def month_of(stamp: Column | str) -> Column:
    """``YYYY-MM`` of a time written as text, null if it does not begin with one."""
    return F.nullif(F.regexp_extract(stamp, r"^(\d{4}-\d{2})", 1), F.lit(""))


def time_format(stamp: Column | str) -> Column:
    """How a time is spelled: utc, offset or other; null for null."""
    stamp = F.col(stamp) if isinstance(stamp, str) else stamp
    return (
        F.when(stamp.isNull(), None)
        .when(stamp.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), "utc")
        .when(stamp.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?[+-]\d{2}:\d{2}$"), "offset")
        .otherwise("other")
    )


def instant(stamp: Column | str) -> Column:
    """The timestamp of a time written as text, in any offset; null if it cannot be read."""
    return F.try_to_timestamp(F.col(stamp) if isinstance(stamp, str) else stamp)


def epoch_to_iso(seconds: Column | str) -> Column:
    """Epoch seconds or milliseconds as ISO 8601 UTC text."""
    value = F.col(seconds).cast("double") if isinstance(seconds, str) else seconds.cast("double")
    micros = F.when(F.abs(value) >= 1e11, value * 1000).otherwise(value * 1_000_000)
    return F.date_format(F.timestamp_micros(micros.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))


def framed_digest(*parts: Column | str) -> Column:
    """SHA-256 over the parts, each after its length as eight bytes, so parts cannot run together. Null counts as empty."""
    framed = []
    for part in parts:
        value = F.coalesce(F.col(part) if isinstance(part, str) else part, F.lit("")).cast("string")
        framed += [F.unhex(F.lpad(F.hex(F.octet_length(value)), 16, "0")), value.cast("binary")]
    return F.sha2(F.concat(*framed), 256)


# Shapes of secrets in log texts, and the names whose values are secrets whatever they look like.
_REDACT = [
    (r"(?i)\b(bearer\s)\s*[A-Za-z0-9._~+/=-]+", "$1[REDACTED]"),
    (r"(?i)\b((?:api[_-]?key|token|password|passwd|secret)\s*[:=])\s*[^\s,;]+", "$1[REDACTED]"),
    (r"\b(?:sk-[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9_]{8,}|github_pat_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9-]{8,})\b", "[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "[REDACTED]"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED]"),
    (r"\bAIza[0-9A-Za-z_-]{35}\b", "[REDACTED]"),
    (r"(?s)-----BEGIN [^-]*PRIVATE KEY-----.*?-----END [^-]*PRIVATE KEY-----", "[REDACTED]"),
]
SECRET_NAME = r"(?i)(api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|session[_-]?key|token|password|passwd|secret|credential|authorization|cookie)"


def redact_text(text: Column | str) -> Column:
    """A log text with secrets blanked by shape; a chain of built-in replacements."""
    out = F.col(text) if isinstance(text, str) else text
    for pattern, into in _REDACT:
        out = F.regexp_replace(out, pattern, into)
    return out


def redact_log(text: Column | str) -> Column:
    """A log record with secrets blanked: in JSON also every value, whole or nested, under a name that tells a secret.

    A record that is no JSON object or array is a text. Null stays null.
    """
    import json
    import re

    name = re.compile(SECRET_NAME)
    shapes = [(re.compile(p), into.replace("$1", r"\1")) for p, into in _REDACT]

    def clean(key: str, value: object) -> object:
        if name.search(key):
            return "[REDACTED]"
        if isinstance(value, dict):
            return {k: clean(k, v) for k, v in value.items()}
        if isinstance(value, list):
            return [clean(key, v) for v in value]
        if isinstance(value, str):
            for shape, into in shapes:
                value = shape.sub(into, value)
        return value

    @F.pandas_udf("string")
    def run(records: pd.Series) -> pd.Series:
        out = []
        for record in records:
            try:
                found = json.loads(record)
            except ValueError:
                found = None
            out.append(json.dumps(clean("", found), ensure_ascii=False, sort_keys=True, separators=(",", ":")) if isinstance(found, (dict, list)) else None)
        return pd.Series(out, dtype=object)

    value = F.col(text) if isinstance(text, str) else text
    looks = F.coalesce(F.ltrim(value).rlike(r"^[\[{]"), F.lit(False))
    return F.coalesce(F.when(looks, run(F.when(looks, value).otherwise("0"))), redact_text(value))
