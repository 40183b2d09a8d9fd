"""Records that differ only in dress: white space, case, punctuation or order of named fields.

Each distinct value of an Arrow batch is brought to canonical form once and encoded as integers: 128-bit
content identifiers in two longs, the same in every task without a dictionary that would have to be
shuffled or sent. A record becomes a sorted tuple of its fields' integers, and only those compact tuples
are shuffled and grouped. Records are one class if a chain of equal letters or equal fields joins them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.components import connected_components
from threadloom.operators.skew import HOT_ROWS, join_unique
from threadloom.session import checkpoint

#: Records with fewer letters and digits carry too little to be compared.
LEAST_CHARS = 20
_NOISE = re.compile(r"[\W_]+")
_FIELD = re.compile(r"\s*[^\s:][^:\n]*?\s*:(?:\s.*|)$")


def canonical(text: str) -> str:
    """Letters and digits in order, in lower case."""
    return _NOISE.sub("", text.lower())


def named_fields(text: str) -> list[tuple[str, str]] | None:
    """The (name, value) pairs of a JSON object or of three or more ``name: value`` lines; else None."""
    head = text.lstrip()
    if head.startswith("{"):
        try:
            found = json.loads(text)
        except (ValueError, RecursionError):
            return None
        return [(canonical(k), _value(v)) for k, v in found.items()] if isinstance(found, dict) else None
    lines = [line for line in text.splitlines() if line.strip()]
    if len(lines) >= 3 and all(_FIELD.match(line) for line in lines):
        return [(canonical(name), canonical(value)) for name, _, value in (line.partition(":") for line in lines)]
    return None


def _value(value: object) -> str:
    """Canonical text of a JSON value; objects inside are ordered by name."""
    if isinstance(value, dict):
        return "{" + ",".join(sorted(f"{canonical(k)}={_value(v)}" for k, v in value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_value, value)) + "]"
    return canonical(value if isinstance(value, str) else json.dumps(value))


def _number(text: str) -> tuple[int, int]:
    """A 128-bit identifier as two signed longs."""
    whole = xxhash.xxh3_128_intdigest(text)
    return tuple(x - (1 << 63) for x in (whole >> 64, whole & (1 << 64) - 1))


def encode(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(id, letters array<bigint>, fields array<bigint>)`` of each record long enough to compare.

    letters is the identifier of the canonical text; fields is the sorted tuple of name and value
    identifiers, null unless the content is made of named fields.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places, values = pd.factorize(batch["t"])
            letters: list = [None] * len(values)
            fields: list = [None] * len(values)
            for i, text in enumerate(values):
                plain = canonical(text)
                if len(plain) < LEAST_CHARS:
                    continue
                letters[i] = _number(plain)
                pairs = named_fields(text) if ":" in text else None
                if pairs:
                    fields[i] = [n for pair in sorted((*_number(a), *_number(b)) for a, b in pairs) for n in pair]
            out = pd.DataFrame({"id": batch["k"], "letters": [letters[p] for p in places], "fields": [fields[p] for p in places]})
            yield out[out["letters"].notna()]

    return df.select(F.col(key).alias("k"), F.col(column).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL").mapInPandas(run, "id bigint, letters array<bigint>, fields array<bigint>")


def _linked_fields(encoded: DataFrame, texts: DataFrame, by: str, hot_rows: int) -> DataFrame:
    """``(by, first, joined)``: for field tuples that texts of equal letters tie together, the tuple that stands for all of them.

    Equal letters may part into fields in several ways (``ab: c`` and ``a: bc``). Only letters with more than one
    tuple take part; their tuples get integers, and the components of the links give the classes.
    """
    doubtful = texts.filter("fields <> last_fields").select(by, "letters", F.col("fields").alias("first"))
    forms = encoded.filter("fields IS NOT NULL").select(by, "letters", "fields").distinct()
    pairs = checkpoint(forms.join(doubtful, [by, "letters"]).select(by, "first", "fields").filter("first <> fields").distinct())
    tuples = pairs.select(by, F.col("first").alias("fields")).unionByName(pairs.select(by, "fields")).distinct()
    dictionary = checkpoint(tuples.withColumn("number", F.monotonically_increasing_id()))
    first = dictionary.select(by, F.col("fields").alias("first"), F.col("number").alias("a"))
    edges = pairs.join(first, [by, "first"]).join(dictionary.withColumnRenamed("number", "b"), [by, "fields"]).select("a", "b")
    classes = connected_components(edges, hot_rows)
    numbered = dictionary.join(classes, dictionary.number == classes.node)
    least = numbered.groupBy("component").agg(F.min("fields").alias("joined"))
    return numbered.join(least, "component").select(by, F.col("fields").alias("first"), "joined")


def copy_classes(encoded: DataFrame, by: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct ``letters`` with their class: class_id (smallest id), copies and rows of that text.

    Texts of equal letters are one class whatever their form; texts of equal fields are one class in
    any order; what is equal to equal records is in the same class. The aggregates combine before the shuffle.
    """
    texts = encoded.groupBy(by, "letters").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min("fields").alias("fields"), F.max("fields").alias("last_fields"))
    texts = checkpoint(texts)
    if not texts.filter("fields <> last_fields").isEmpty():
        linked = _linked_fields(encoded, texts, by, hot_rows)
        texts = texts.join(linked, (texts[by] == linked[by]) & (texts.fields == linked["first"]), "left").select(texts[by], "letters", "least", "n", F.coalesce("joined", "fields").alias("fields"))
        texts = checkpoint(texts)
    texts = texts.withColumn("form", F.coalesce("fields", "letters"))
    classes = texts.groupBy(by, "form").agg(F.min("least").alias("class_id"), F.sum("n").alias("copies"), F.count("*").alias("spellings"))
    total = texts.count()
    keyed = texts.withColumn("of", F.struct(by, "form")).select(by, "letters", "least", "n", "of")
    return join_unique(keyed, classes.select(F.struct(by, "form").alias("of"), "class_id", "copies", "spellings"), "of", "spellings", total, hot_rows=hot_rows).drop("of")


def format_duplicates(encoded: DataFrame, by: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(by, id, class_id, copies)`` of every record that has a copy; class_id is the record kept.

    Null and short records are left out, repeated rows count as copies unless they repeat the id, an
    empty table gives an empty result. A class of any size is grouped by its tuple alone and joined
    back without bringing its rows together.
    """
    encoded = checkpoint(encoded.dropDuplicates([by, "id"]))
    total = encoded.count()
    classes = copy_classes(encoded, by, hot_rows).filter("copies > 1").select(F.struct(by, "letters").alias("of"), "class_id", "copies", "n")
    rows = encoded.select(by, "id", F.struct(by, "letters").alias("of"))
    return join_unique(rows, classes, "of", "n", total, hot_rows=hot_rows).select(by, "id", "class_id", "copies")
