import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def fnv(s):
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


@pytest.mark.parametrize("s", ["", "foobar", "привет", "a" * 300, None])
def test_fnv(spark, s):
    assert one(spark, X.fnv1a32, s) == (None if s is None else fnv(s))


def test_fnv_known_value(spark):
    assert one(spark, X.fnv1a32, "foobar") == 0xBF9CF968


@pytest.mark.parametrize("s", ["short", "x" * 500, "y" * 501, "ж" * 400, "a" + "日" * 300, "", None])
def test_byte_cap(spark, s):
    got = one(spark, lambda c: X.capped_bytes(c, 500), s)
    if s is None or len(s.encode()) <= 500:
        assert got == s
    else:
        room = s.encode()[:497].decode("utf-8", "ignore")
        assert got == room + "..." and len(got.encode()) <= 500


def test_boundaries_of_other_alphabets(spark):
    assert one(spark, lambda c: X.has_phrase(c, ["вода"]), "чистая ВОДА!") is True
    assert one(spark, lambda c: X.has_phrase(c, ["вода"]), "водами") is False
    assert one(spark, lambda c: X.has_phrase(c, ["a b"]), "xa bx") is True
    assert one(spark, lambda c: X.has_phrase(c, ["a.b+"]), "see a.b+ now") is True
    assert one(spark, lambda c: X.has_phrase(c, ["x"]), None) is False
    assert one(spark, lambda c: X.first_phrase(c, ["b", "a"]), "a b") == "b"


def test_re2_boundary_is_ascii(spark):
    assert one(spark, lambda c: c.rlike(X.re2(r"(?i)\bвода\b")), "вода") is False
    assert one(spark, lambda c: c.rlike(X.re2(r"(?i)\bwater\b")), "Water!") is True


@pytest.mark.parametrize("url,host", [("https://www.A.example/x?y", "a.example"), ("b.test:80/", "b.test"), ("http://u@c.invalid.", "c.invalid"), ("", None), (None, None)])
def test_host(spark, url, host):
    assert one(spark, X.host, url) == host


def test_suffixes_and_shard(spark):
    assert one(spark, X.parent_suffixes, "a.b.example") == ["a.b.example", "b.example", "example"]
    assert one(spark, lambda c: X.stable_shard(c, 8), "k") == hashlib.sha256(b"k").digest()[0] % 8


def test_masks_and_spans(spark):
    assert one(spark, X.masked_contact, "ann@host.example") == "an***@host.example"
    assert one(spark, X.masked_contact, "@handle") == "@h***"
    assert [one(spark, X.span_seconds, s) for s in ("24h", "7d", "x", None)] == [86400, 604800, None, None]


def test_visible_text(spark):
    html = "<html><head><title>t</title></head><body><script>x</script><p>A &amp; B</p><!-- no -->\n<b>C</b></body>"
    assert one(spark, X.visible, html) == "A & B C"


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=60))
def test_natural_words_property(spark, s):
    got = one(spark, X.natural_words, s)
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", s)]
    assert got == sum(sum(ch.isalpha() for ch in w) >= 3 for w in words) or not s.isascii()
