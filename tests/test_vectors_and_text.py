import base64
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec.functions import sizing, vectors
from lodevec.functions import text as T
from lodevec.functions.vectors import _half_bits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*xs):
    return F.array(*(F.lit(float(x)).cast("float") for x in xs))


def test_metrics(spark):
    assert one(spark, vectors.dot(vec(1, 2), vec(3, 4))) == 11
    assert one(spark, vectors.cosine(vec(0, 0), vec(3, 4))) == 0
    assert one(spark, vectors.cosine(vec(-2, 0), vec(5, 0))) == -1
    assert one(spark, vectors.similarity(vec(0, 0), vec(3, 4), "l2")) == pytest.approx(1 / 26)
    with pytest.raises(ValueError):
        vectors.similarity(vec(0), vec(1), "manhattan")


def test_normalize(spark):
    assert one(spark, vectors.l2_normalize(vec(0, 0))) is None
    assert one(spark, vectors.l2_normalize(vec(1e-20, 0))) == [1.0, 0.0]
    assert one(spark, vectors.normalize_or_keep(vec(0, 0))) == [0.0, 0.0]


@pytest.mark.parametrize("x,bits", [(1.0, 0x3C00), (-2.5, 0xC100), (0.1, 0x2E66), (1 / 3, 0x3555), (65504, 0x7BFF), (65520, 0x7BFF), (1e-5, 0x00A7), (1e-8, 0), (70000, 0x7C00), (float("inf"), 0x7C00)])
def test_float16_truncates(x, bits):
    assert int(_half_bits(np.array([x], np.float32))[0]) == bits


def test_float16_widens(spark):
    assert one(spark, vectors.from_float16(vectors.to_float16(vec(0.5, -2.5, 0)))) == [0.5, -2.5, 0]


def test_int8(spark):
    assert one(spark, vectors.quantize_int8(vec(0.5, -0.25, 1, 0.003), F.lit(1.0))) == [64, -32, 127, 0]
    assert one(spark, vectors.quantize_int8(vec(2, -1, 0.01), F.lit(2.0))) == [127, -64, 1]
    assert one(spark, vectors.quantize_int8(vec(2, -1), F.lit(0.0))) == [0, 0]


def test_base64(spark):
    text = "AACAPwAAAL8AAIA+"
    assert one(spark, vectors.encode_base64(vec(1, -0.5, 0.25))) == text
    assert one(spark, vectors.decode_base64(F.lit(text), 3)) == [1, -0.5, 0.25]
    assert one(spark, vectors.decode_base64(F.lit(text + "AA"), 2)) == [1, -0.5]
    assert one(spark, vectors.decode_base64(F.lit(text), 4)) is None
    assert base64.b64decode(text)


TAGS = [
    ({"x": 5}, {"x": {"$eq": 5}}, True), ({"x": 5}, {"x": {"$ne": 5}}, False), ({"other": 1}, {"x": {"$ne": 5}}, False),
    (None, {"lang": {"$in": ["ts"]}}, False), (None, {"lang": {"$nin": ["ts", "js"]}}, True), (None, {"lang": {"$exists": False}}, True),
    (None, {"lang": {"$nin": [None]}}, False), (None, {"lang": None}, False), ({"n": 5}, {"n": {"$gte": 1, "$lte": 10}}, True),
    ({"n": 5}, {"n": {"$gt": 4, "$lt": 6}}, True), ({"n": 1}, {"n": {"$eq": 1, "$gt": 5}}, True), ({}, {"x": {"$eq": 1, "$nin": [2]}}, True),
    ({"n": 10}, {"n": {"$gt": "9"}}, False), ({"x": None}, {"x": {"$gte": 0}}, False), ({"x": None}, {"x": {}}, False),
    ({"name": "beta"}, {"name": {"$gte": "alpha", "$lte": "gamma"}}, True), ({"a": 1}, {}, True), ({"x": None}, {"x": None}, True),
    ({"x": "5"}, {"x": 5}, False), ({"x": 5}, {"x": "5"}, False), ({"x": True}, {"x": True}, True), ({"x": 1}, {"x": True}, False), ({"x": 1.5}, {"x": 1.5}, True),
]


def test_predicates(spark):
    cols = [F.coalesce(T.matches(F.try_parse_json(F.lit(None if t is None else json.dumps(t)).cast("string")), w), F.lit(False)).alias(f"c{i}") for i, (t, w, _) in enumerate(TAGS)]
    got = spark.range(1).select(*cols).first()
    assert [got[f"c{i}"] for i in range(len(TAGS))] == [x for _, _, x in TAGS]


def test_tag_suffix(spark):
    stored = T.add_tags(F.lit("a\n[tags:{\"x\":0}]"), F.lit('{"x":1}'))
    assert one(spark, stored) == 'a\n[tags:{"x":1}]'
    assert one(spark, T.strip_tags(stored)) == "a"
    for bad in ("a", "a\n[tags:{bad]", "a\n[tags:[1]]", 'a\n[tags:{"x":1}'):
        assert one(spark, T.parse_tags(F.lit(bad)).isNull())
    with pytest.raises(ValueError):
        T.validate_tags({"k" * 65: 1})
    with pytest.raises(ValueError):
        T.validate_tags({"k": [1]})
    assert T.validate_tags({"k": None}) == {"k": None}


def test_text(spark):
    assert one(spark, T.tokens(F.lit("The idea: a Café-2000 is it"))) == ["idea", "caf", "2000"]
    assert one(spark, T.js_round(F.lit(-0.00005))) == 0
    assert one(spark, T.text_problem(F.lit("ok\ttext\n"))) is None
    assert one(spark, T.text_problem(F.lit("a\x00"))) == "control"
    assert one(spark, T.text_problem(F.lit("a‮b"))) == "hidden"
    assert one(spark, T.text_problem(F.lit("﻿a"))) is None
    assert one(spark, T.text_problem(F.lit("a﻿"))) == "hidden"
    assert one(spark, T.nfc(F.lit("é"))) == "é"
    assert one(spark, T.namespace_slug(F.lit("My Repo!"))) == "project-my-repo-"
    for bad in ("bad namespace", "../../etc/passwd", "..", ""):
        with pytest.raises(ValueError):
            T.valid_namespace(bad)
    assert T.valid_namespace("ns_1.2") == "ns_1.2"


def test_sizes(spark):
    r = sizing.table(spark, [1_000_000], [768]).first()
    assert (r["vector_bytes"], r["index_bytes"], r["metadata_bytes"]) == (3_072_000_032, 144_000_000, 240_000_000)


def test_random_float16_against_numpy():
    random.seed(1)
    x = np.array([random.uniform(-100, 100) for _ in range(2000)], np.float32)
    mine = _half_bits(x).view(np.float16).astype(np.float32)
    assert (np.abs(mine) <= np.abs(x)).all() and (np.abs(mine - x) <= np.abs(x) * 2**-10).all()
