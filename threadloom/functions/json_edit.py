"""JSON edits and text marking that built-in expressions lack, as Arrow-batched functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import fold_text

_STEP = re.compile(r"\.(?:\"([^\"]*)\"|([^.\[]+))|\[(#?-?\d*)\]")


def merge_patch(target: object, patch: object) -> object:
    """RFC 7396: objects merge, null removes, anything else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = merge_patch(out.get(key), value)
    return out


def _load(text: str | None) -> object:
    return json.loads(text)


def _said(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _steps(path: str) -> list[str | int]:
    if not path.startswith("$"):
        raise ValueError(path)
    out: list[str | int] = []
    for quoted, plain, place in _STEP.findall(path[1:]):
        out.append(int(place.replace("#", "") or -1) if place else quoted or plain)
    return out


def _value(text: str | None) -> object:
    """A new value as written: numbers stay numbers, all else is a string."""
    if text is None:
        return None
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d*\.\d+(?:[eE][+-]?\d+)?", text):
        return float(text)
    return text


def edit(document: object, path: str, value: object, existing: bool, missing: bool) -> object:
    """The document with ``value`` at ``path`` where the place exists (``existing``) or does not (``missing``)."""
    steps = _steps(path)
    if not steps:
        return value if existing else document
    at = document
    for step in steps[:-1]:
        try:
            at = at[step]
        except (KeyError, IndexError, TypeError):
            return document
    last = steps[-1]
    if isinstance(at, dict) and isinstance(last, str):
        if (last in at and existing) or (last not in at and missing):
            at[last] = value
    elif isinstance(at, list) and isinstance(last, int):
        if -len(at) <= last < len(at):
            if existing:
                at[last] = value
        elif last == len(at) and missing:
            at.append(value)
    return document


def remove(document: object, path: str) -> object:
    steps = _steps(path)
    at = document
    for step in steps[:-1]:
        try:
            at = at[step]
        except (KeyError, IndexError, TypeError):
            return document
    try:
        del at[steps[-1]]
    except (KeyError, IndexError, TypeError):
        pass
    return document


def _each(run):
    """Null in, null out; what cannot be read as JSON gives null."""

    def over(first: pd.Series, *rest: pd.Series) -> pd.Series:
        out = []
        for values in zip(first, *rest):
            try:
                out.append(None if values[0] is None else run(*values))
            except (ValueError, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return over


def _editor(existing: bool, missing: bool):
    def run(text: str, pairs: list) -> str:
        document = _load(text)
        for path, value in zip(pairs[::2], pairs[1::2]):
            document = edit(document, path, _value(value), existing, missing)
        return _said(document)

    return run


def highlight(text: str, words: str, begin: str = "<b>", end: str = "</b>") -> str:
    """The text with every whole word of ``words`` marked, whatever its case and accents."""
    wanted = set(re.findall(r"[^\W_]+", fold_text(words)))
    return re.sub(r"[^\W_]+", lambda m: f"{begin}{m.group()}{end}" if fold_text(m.group()) in wanted else m.group(), text)


def snippet(text: str, words: str, size: int = 16) -> str:
    """The window of ``size`` words that holds most different search words, the first of equals."""
    wanted = set(re.findall(r"[^\W_]+", fold_text(words)))
    found = list(re.finditer(r"[^\W_]+", text))
    best, start = -1, 0
    for at in range(max(1, len(found) - size + 1)):
        score = len({w for m in found[at : at + size] if (w := fold_text(m.group())) in wanted})
        if score > best:
            best, start = score, at
    if not found:
        return text
    last = found[min(start + size, len(found)) - 1]
    return ("…" if start else "") + text[found[start].start() : last.end()] + ("…" if last is not found[-1] else "")


def _error_position(text: str) -> int:
    try:
        json.loads(text)
    except json.JSONDecodeError as error:
        return error.pos + 1
    return 0


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL under names that only the dialect layer writes."""

    def patch_udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(lambda x, y: _said(merge_patch(_load(x), _load(y))))(a, b)

    def set_udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(_editor(True, True))(a, b)

    def insert_udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(_editor(False, True))(a, b)

    def replace_udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(_editor(True, False))(a, b)

    def remove_udf(a: pd.Series, b: pd.Series) -> pd.Series:
        def run(text: str, paths: list) -> str:
            document = _load(text)
            for path in paths:
                document = remove(document, path)
            return _said(document)

        return _each(run)(a, b)

    def highlight_udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(highlight)(a, b)

    def snippet_udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(snippet)(a, b)

    def error_udf(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _error_position(x) for x in a], dtype="Int64")

    for name, run in (("json_patch", patch_udf), ("json_set", set_udf), ("json_insert", insert_udf), ("json_replace", replace_udf), ("json_remove", remove_udf), ("highlight", highlight_udf), ("snippet", snippet_udf)):
        spark.udf.register(f"threadloom_{name}", F.pandas_udf(run, "string"))
    spark.udf.register("threadloom_json_error_position", F.pandas_udf(error_udf, "bigint"))
