"""Text expressions: lexical tokens and scores, labels, tags, validation."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = tuple(sorted(set("""
you your would with will were we was to this those they these their the that she shall should or our
on of my might may its it is in i his he her have has had for do does did could can by be been being
but at are and an a
""".split()) - {"by"}))
K1, B = 1.5, 0.75
TAG_MARK = "\n[tags:"


def js_round(x: Column, digits: int = 4) -> Column:
    """Half up towards plus infinity, as JavaScript rounds."""
    p = 10.0**digits
    return F.floor(x * p + 0.5) / p


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case ASCII words of two characters and more that are no stop words, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def bind(value: Column, use) -> Column:
    """use(value) with value as a lambda variable: evaluated once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _saturated(f: Column, n: Column, average: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * (n / average)))


def bm25(query: Column, doc: Column, average: Column) -> Column:
    """BM25 without document frequencies; repeated query tokens count each time.

    For a pool of candidates: the document is scanned once for the query's tokens, and frequencies
    are counted among those found. For whole tables see bm25_scores.
    """

    def score(s: Column) -> Column:
        def term(t: Column) -> Column:
            f = F.size(F.filter(s["hits"], lambda d: d == t)).cast("double")
            return F.when(f == 0, 0.0).otherwise(_saturated(f, s["n"], average))

        return F.aggregate(F.transform(query, term), F.lit(0.0), lambda x, y: x + y)

    return bind(doc, lambda d: bind(F.struct(F.filter(d, lambda t: F.array_contains(query, t)).alias("hits"), F.size(d).alias("n")), score))


def bm25_scores(docs: DataFrame, queries: DataFrame, key: str = "id", query_key: str = "query_id", text: str = "text") -> DataFrame:
    """Rows (query_id, id, score) of the documents that share a token with a query, by an equi-join on tokens.

    Documents' words become rows, which meet the queries' different words only; frequencies are
    counted by document and word, before queries that share a word fan out. Keys are taken as unique.
    """

    def words(t: DataFrame, key: str, name: str) -> DataFrame:
        w = t.select(F.col(key).alias(name), F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+")).alias("__t"))
        return w.where((F.length("__t") > 1) & ~F.col("__t").isin(*STOP_WORDS))

    d = words(docs, key, "id")
    lengths = d.groupBy("id").agg(F.count("*").alias("__n"))
    total = lengths.agg(F.sum("__n").alias("__a")).crossJoin(docs.agg(F.count("*").alias("__c")))  # one row
    average = total.select(F.when(F.col("__a") > 0, F.col("__a") / F.col("__c")).otherwise(1.0).alias("__a"))
    q = words(queries, query_key, "query_id").groupBy("query_id", "__t").agg(F.count("*").alias("__m"))
    found = d.join(q.select("__t").distinct(), "__t", "left_semi").groupBy("id", "__t").agg(F.count("*").cast("double").alias("__f"))
    found = found.join(lengths, "id").crossJoin(F.broadcast(average)).withColumn("__s", _saturated(F.col("__f"), F.col("__n"), F.col("__a")))
    return found.join(q, "__t").groupBy("query_id", "id").agg(F.sum(F.col("__s") * F.col("__m")).alias("score"))


# ---------------------------------------------------------------- labels


def file_label(path: Column, i: Column, n: Column, text: Column, separator: str = " ") -> Column:
    """`[file:P][chunk:i/n]`, a blank or a line feed, and the text."""
    return F.concat(F.format_string("[file:%s][chunk:%d/%d]", path, i, n), F.lit(separator), text)


LABEL = r"^\[file:(.*?)\]\[chunk:(\d+)/(\d+)\]\s?"


def label_path(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, LABEL, 1), F.lit(""))


def strip_label(text: Column) -> Column:
    return F.regexp_replace(text, LABEL, "")


def namespace_slug(text: Column, prefix: str = "project-") -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"))


_NAMESPACE = r"[A-Za-z0-9_.-]+"


def valid_namespace(name: str) -> str:
    if not re.fullmatch(_NAMESPACE, name or "") or name in (".", ".."):
        raise ValueError(f"not a namespace: {name!r}")
    return name


def is_namespace(name: Column) -> Column:
    """The same as an expression; false for null."""
    return F.coalesce(name.rlike(rf"\A{_NAMESPACE}\z") & ~name.isin(".", ".."), F.lit(False))


def iso_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# ---------------------------------------------------------------- validation

MAX_CHARS, MAX_META = 512 * 1024, 32 * 1024
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
_HIDDEN = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{2066}-\x{2069}\x{E0000}-\x{E007F}]"


def text_problem(text: Column, limit: int = MAX_CHARS) -> Column:
    """Why a text may not be stored: 'control', 'hidden' or 'length'; null if it may."""
    late_mark = F.expr("1 = 0") | (F.instr(F.substring(text, 2, 2**31 - 1), "﻿") > 0)
    return (
        F.when(F.length(text) > limit, "length")
        .when(text.rlike(_CONTROL), "control")
        .when(text.rlike(_HIDDEN) | late_mark, "hidden")
    )


def nfc(text: Column) -> Column:
    """Unicode normal form C; only texts with non-ASCII characters go to Python."""
    import pyarrow as pa

    def udf(v: pa.Array) -> pa.Array:
        return normal(v)

    udf.__annotations__ = {"v": pa.Array, "return": pa.Array}
    is_ascii = text.rlike(r"^\p{ASCII}*$")
    return F.when(is_ascii, text).otherwise(F.arrow_udf(udf, "string")(F.when(~is_ascii, text)))


def normal(v, some: int = 96):
    """An Arrow array of texts in normal form C. `some` texts at a time are Python objects, and those that are normal stay as they are."""
    import unicodedata

    import pyarrow as pa

    parts, changed = [], False
    for i in range(0, len(v), some):
        texts = v.slice(i, some).to_pylist()
        own = [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
        parts.append(v.slice(i, some) if own == texts else pa.array(own, v.type))
        changed |= own != texts
    return pa.concat_arrays(parts) if changed else v


# ---------------------------------------------------------------- tags


def strip_tags(text: Column) -> Column:
    cut = F.length(F.substring_index(text, TAG_MARK, -1)) + len(TAG_MARK)
    return F.when(F.instr(text, TAG_MARK) > 0, F.substring(text, F.lit(1), F.length(text) - cut)).otherwise(text)


def add_tags(text: Column, tags_json: Column) -> Column:
    """The text with its tags as a suffix, in place of any it has."""
    return F.concat(strip_tags(text), F.lit(TAG_MARK), tags_json, F.lit("]"))


def parse_tags(text: Column) -> Column:
    """The tags of a stored text as variant; null without a well-formed suffix that is an object."""

    def payload(t: Column) -> Column:
        p = F.substring_index(t, TAG_MARK, -1)
        return F.when((F.instr(t, TAG_MARK) > 0) & p.endswith("]"), F.substring(p, F.lit(1), F.length(p) - 1))

    return bind(F.try_parse_json(bind(text, payload)), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def validate_tags(tags: dict) -> dict:
    """At most 32 scalar tags, keys of 64 and texts of 256 characters."""
    if not isinstance(tags, dict) or len(tags) > 32:
        raise ValueError("tags must be an object of at most 32 keys")
    for k, v in tags.items():
        if len(k) > 64 or isinstance(v, str) and len(v) > 256 or not (v is None or isinstance(v, (str, int, float, bool))):
            raise ValueError(f"tag {k[:20]!r} is too long or no scalar")
    return tags


def tags_json(**columns: Column) -> Column:
    """A JSON object of columns; null ones are left out."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())))


class Tag:
    """One key of a variant column: its presence, type class and value."""

    def __init__(self, tags: Column, key: str):
        quote = '"' if "'" in key else "'"
        if not key or quote in key or "\\" in key:  # a path can't say both quotes
            raise ValueError(f"unsupported tag key {key!r}")
        path = f"$[{quote}{key}{quote}]"
        v = F.try_variant_get(tags, path, "variant")
        kind = F.schema_of_variant(v)
        self.there = v.isNotNull()
        self.null = kind == "VOID"
        self.is_number = kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        self.is_text, self.is_bool = kind == "STRING", kind == "BOOLEAN"
        self.number = F.try_variant_get(tags, path, "double")
        self.text = F.try_variant_get(tags, path, "string")
        self.bool = F.try_variant_get(tags, path, "boolean")

    def equals(self, value) -> Column:
        """Same type and same value; false where the key is missing."""
        if value is None:
            hit = self.null
        elif isinstance(value, bool):
            hit = self.is_bool & (self.bool == value)
        elif isinstance(value, (int, float)):
            hit = self.is_number & (self.number == float(value))
        elif isinstance(value, str):
            hit = self.is_text & (self.text == value)
        else:
            return F.lit(False)
        return F.coalesce(self.there & hit, F.lit(False))

    def compares(self, op: str, value) -> Column:
        """Numbers as numbers, anything else as text."""
        ops = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
        plain = "" if value is None else json.dumps(value) if isinstance(value, bool) else f"{value:g}" if isinstance(value, float) else str(value)
        as_text = ops[op](self.text, F.lit(plain))
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return F.when(self.is_number, ops[op](self.number, F.lit(float(value)))).otherwise(as_text)
        return as_text


def matches(tags: Column, wanted: dict) -> Column:
    """Compile a predicate object into one Catalyst expression; keys are joined by AND, {} matches all.

    Within a key the first of $exists, $eq, $ne, $in, $nin decides alone; only the four range
    operators combine. On a missing key only $exists: false and a $nin without null are true.
    The tags are bound to a lambda variable: they are parsed once a row, however often a predicate
    names them, and generated code stays small.
    """
    if not wanted:
        return F.lit(True)
    return bind(tags, lambda v: _matches(v, wanted))


def _matches(tags: Column, wanted: dict) -> Column:
    out = F.lit(True)
    for key, want in wanted.items():
        t = Tag(tags, key)
        if not isinstance(want, dict):
            hit = F.lit(False) if isinstance(want, (list, tuple)) else t.equals(want)
        elif "$exists" in want:
            hit = t.there if want["$exists"] else ~t.there
        else:
            any_of = lambda vs: F.coalesce(_any(t.equals(v) for v in vs), F.lit(False))
            listed = isinstance(want.get("$nin"), (list, tuple))
            missing = F.lit(listed and None not in want["$nin"]) if "$nin" in want else F.lit(False)
            if "$eq" in want:
                there = t.equals(want["$eq"])
            elif "$ne" in want:
                there = ~t.equals(want["$ne"])
            elif "$in" in want:
                there = any_of(want["$in"]) if isinstance(want["$in"], (list, tuple)) else F.lit(False)
            elif "$nin" in want:
                there = ~any_of(want["$nin"]) if listed else F.lit(False)
            else:
                there = ~t.null
                for op in ("$gt", "$gte", "$lt", "$lte"):
                    if op in want:
                        there = there & t.compares(op, want[op])
            hit = F.when(t.there, there).otherwise(missing)
        out = out & F.coalesce(hit, F.lit(False))
    return out


def _any(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out
