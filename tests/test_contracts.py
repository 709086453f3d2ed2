"""The grammar of templates, inspections, canonical forms and redaction: recorded expectations and Python's own json."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import formatting, privacy
from tessera.operators import grammar, parties


def inspect(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, src string").select("i", grammar.inspect("src").alias("r")).collect()
    return [r.r for r in sorted(rows)]


PAYLOADS = [
    "{{ ''.__class__.__mro__[1].__subclasses__() }}", "{{ config.items() }}", "{{ lipsum.__globals__['os'].popen('calc').read() }}", "{{ self._TemplateReference__context }}", "{{ namespace() }}", "{{ ''['__class__'] }}",
    "{% include 'other.docx' %}", "{% extends 'base.docx' %}", "{% import 'macros.docx' as m %}", "{% from 'x' import y as z %}", "{{ full_name|attr('__class__') }}", "{{ cycler(1, 2) }}", "{{ range(10) }}", "{{ full_name|map('upper') }}",
]


def test_payloads_are_found_and_parse(spark):
    for text, r in zip(PAYLOADS, inspect(spark, PAYLOADS), strict=True):
        assert r.findings and r.error is None, text


CLEAN = {
    "{{ a }}{% if (a) %}{{ 'a|b' }}{% endif %}": ["a"],
    "{{ x|default('{{ y }}') }} {{ \"%}\" }}": ["x"],
    "{{ a if b else c }}{{ d not in e }}{{ not f }}": list("abcdef"),
    "{{ m.n[0].o['k'][p.q][1:2] }}": ["m.n[0].o['k'][][]", "p.q"],
    "{{ (a.b).c }}{{ ((d)).e }}{{ (f ~ g).h }}": ["a.b.c", "d.e", "f", "g"],
    "{% for a, b in c|sort if a.x %}{{ b }}{% for d in b.e %}{{ d }}{{ a }}{% endfor %}{% endfor %}": ["c"],
    "{% for a in b %}{% set c = a %}{{ c }}{% endfor %}{{ c }}": ["b", "c"],
    "{% for i in xs recursive %}{{ loop(i.kids) if i }}{% endfor %}": ["xs"],
    "{% with a = b.c, d = 1 %}{{ a }}{{ d }}{% endwith %}{{ e.0 }}": ["b.c", "e[0]"],
    "{% set t %}{{ in_set }}{% endset %}{{ t }}{{- x -}}{%- if y -%}{%- endif -%}": ["in_set", "x", "y"],
    "{{ họ_tên }} {{ true }} {{ none }} {{ 1.5e3 }} {{ -n }} {{ [q, r] }} {{ {'a': s} }}": ["họ_tên", "n", "q", "r", "s"],
    "{{ a is defined }}{{ b is divisibleby 3 }}{{ c is not sameas(d) }}{{ e == f }}{{ g // h ** i }}": list("abcdefghi"),
    "no tags at all { } % #": [],
    "{% filter upper %}{{ a }}{% endfilter %}{% block b %}{{ c }}{% endblock %}": ["a", "c"],
}


def test_reads(spark):
    for (text, want), r in zip(CLEAN.items(), inspect(spark, list(CLEAN)), strict=True):
        assert r.error is None, text
        assert r.declared == sorted(want), text


def test_loops_in_words(spark):
    r, other, none = inspect(spark, ["{% for a in b.c %}{% endfor %}{% for a in d|sort %}{% endfor %}{% for a in (e) %}{% endfor %}", "{% if x %}{% endif %}", None])
    assert r.loops == ["b.c", "e"] and r.has_loops and not r.has_conditionals and none is None
    assert other.loops == [] and not other.has_loops and other.has_conditionals


def test_errors(spark):
    texts = ["{{ a", "x\n{% if %}{% endif %}", "{{ a }}\n\n{% endfor %}", "{% else %}", "{% for x %}{% endfor %}", "{{ a[1 }}", "{{ ,a }}", "{{ a.1b }}", "{{ a ? b }}", "{% set %}", "{% elif x %}"]
    found = [r.error for r in inspect(spark, texts)]
    assert found[:6] == [0, 1, 2, 0, 0, 0] and None not in [found[k] for k in (7, 8, 9, 10)]


def test_long_template(spark):
    """A text of a megabyte between tags, and quotes without an end in it."""
    text = "it's a \"text\" " * 70_000
    (r,) = inspect(spark, [text + "{{ a }}" + text + "{% for b in c %}{{ b }}{% endfor %}"])
    assert r.declared == ["a", "c"] and r.error is None


SCHEMA = json.dumps([{"key": "holder", "label": "x"}])


def inspection(spark, source, schema=SCHEMA, fields="[]"):
    return parties.inspected(spark.createDataFrame([(source, schema, fields)], "source string, party_schema string, contract_fields string")).first().inspection


def test_unknown_warns_and_does_not_block(spark):
    r = inspection(spark, "{{ khong_co }} {{ holder.full_name }}")
    assert (r.status, r.unknown, r.optional, [(d.code, d.severity) for d in r.diagnostics]) == ("WARNING", ["khong_co"], ["holder.full_name"], [("6009", "WARNING")])
    assert inspection(spark, "{{ khong_co }}", fields=json.dumps([{"key": "khong_co", "required": True}])).status == "VALID"


def test_syntax_error_leaves_nothing(spark):
    r = inspection(spark, "ok\n{{ full_name %}")
    assert (r.status, r.error, r.declared, [d.code for d in r.diagnostics]) == ("INVALID", 1, [], ["6003"])


@pytest.mark.parametrize("schema", [None, "not json", "{}", "[null, 3]"])
def test_odd_schemas(spark, schema):
    assert inspection(spark, "{{ full_name }}", schema, None).status == "VALID"


@pytest.mark.parametrize("more", [{"entity_type": "ORGANIZATION"}, {"entity_type": "ANY"}, {"min": 2}, {"max": 3}, {"collect": ["contact", "org_profile"]}])
def test_unsupported_parties_block(spark, more):
    assert "6016" in [d.code for d in inspection(spark, "{{ full_name }}", json.dumps([{"key": "holder", **more}])).diagnostics if d.severity == "ERROR"]


# --- canonical form ----------------------------------------------------------------------------------------------


def test_canonical_json(spark):
    rng = random.Random(2)
    number = lambda: rng.choice([0.0, -0.0, 1e16, 1e15, 123456789.125, 1e-4, 1e-5, 2.2250738585072014e-308, 1.7976931348623157e308, 1e22, 0.1, -2.5e-7, 3e7, rng.uniform(-1e9, 1e9), rng.uniform(0, 1) * 10.0 ** rng.randrange(-30, 30)])
    text = lambda: rng.choice([None, "", "NGUYỄN VĂN AN", 'a"b\\c/d', "\x00\x1f\x0b\n\t\r\b\f\x7f", "\\u000b", "\U0001f600"])
    rows = [{"b": rng.randrange(-9, 9), "a": text(), "Z": number(), "é": rng.choice([None, True, False]), "m": rng.choice([None, {"y": [number(), None], "x": None, "k\n": []}]), "s": {"q": text(), "p": [{"w": text()}, None]}} for _ in range(200)]
    kind = StructType.fromDDL("b long, a string, Z double, `é` boolean, m map<string,array<double>>, s struct<q:string,p:array<struct<w:string>>>")
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], StructType.fromDDL("i int").add("x", kind))
    got = table.select("i", formatting.canonical_json(F.col("x"), kind).alias("j"), formatting.digest(F.col("x"), kind).alias("d")).collect()
    for i, said, digest in got:
        want = json.dumps(rows[i], ensure_ascii=False, sort_keys=True)
        assert said == want
        assert digest == hashlib.sha256(want.encode()).hexdigest()


def test_canonical_json_refuses_dates(spark):
    with pytest.raises(TypeError, match="date"):
        formatting.canonical_json(F.current_date(), spark.range(1).select(F.current_date().alias("d")).schema["d"].dataType)


# --- redaction ---------------------------------------------------------------------------------------------------


def test_redact_nested(spark):
    kind = StructType.fromDDL("user struct<full_name:string,age:int,tags:array<string>>, home_address array<string>, m map<string,struct<api_key:string,note:string>>, deep map<string,map<string,array<string>>>")
    value = {"user": {"full_name": "Nam Bo", "age": 3, "tags": ["call 0912345678", None]}, "home_address": ["x, Hà Nội", None], "m": {"any": {"api_key": "k", "note": "a@bc.vn"}, "none": None}, "deep": {"x": {"qr_raw": ["P<"], "name": ["An"]}}}
    table = spark.createDataFrame([(value,), (None,)], StructType().add("x", kind))
    one, none = (r.x for r in table.select(privacy.redact(F.col("x"), kind).alias("x")).collect())
    assert none is None
    assert one.asDict(True) == {
        "user": {"full_name": "N** B*", "age": 3, "tags": ["call •••••••678", None]}, "home_address": ["[địa chỉ] Hà Nội", None],
        "m": {"any": {"api_key": "[REDACTED]", "note": "a***@b***.vn"}, "none": None}, "deep": {"x": {"qr_raw": ["[REDACTED:qr_raw]"], "name": ["A*"]}},
    }
