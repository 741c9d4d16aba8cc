"""Column expressions against a plain walk over generated documents."""

import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from eventloom.config import DEFAULT_BLOCKLIST, Identity, Limits, Privacy, Settings
from eventloom.functions import jsontext as jt
from eventloom.functions.paths import segments, variant_path
from eventloom.operators import governance as gov
from eventloom.operators.nodes import json_nodes
from eventloom.operators.redaction import match_pattern, redact_processor, redaction_audit
import walker

KEYS = st.sampled_from(["a", "b.c", "token", "Api-Key", " password ", "x:y", 'q"r', "back\\slash", "é", "session", ","])
TEXTS = st.one_of(
    st.sampled_from(["", "Bearer abcdefghijklmnop", "\bearer abcdefghijklmnop", "bearer\tabcdefghijkl", 'a,"token":1',
                     "}{][", "sk-0123456789abcdef", "sk-short", "\\", '":"', "ünï", "-----BEGIN RSA PRIVATE KEY-----"]),
    st.text(max_size=12),
)
VALUES = st.recursive(
    st.one_of(TEXTS, st.integers(-5, 10**12), st.booleans(), st.none()),
    lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(KEYS, inner, max_size=5)),
    max_leaves=14,
)
DOCUMENTS = st.lists(st.dictionaries(KEYS, VALUES, max_size=5), min_size=40, max_size=40)
SLOW = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)


def _encodable(doc):
    try:
        json.dumps(doc, ensure_ascii=False).encode()
    except UnicodeEncodeError:
        return False
    return True


@SLOW
@given(DOCUMENTS, st.booleans())
def test_measures_and_nodes(events, docs, ascii_only):
    docs = [d for d in docs if _encodable(d)]
    rows = gov.parse_events(events(*(walker.dumps(d, ascii_only) for d in docs)))
    text = F.to_json("doc")
    got = {r.n: (r.c, r.d) for r in rows.select("n", jt.field_count(text).alias("c"), jt.max_depth(text).alias("d")).collect()}
    assert got == {i: (walker.count(d), walker.depth(d)) for i, d in enumerate(docs)}
    found = sorted((r.n, r.path) for r in json_nodes(rows, keep=("n",)).collect())
    assert found == sorted((i, path) for i, d in enumerate(docs) for path, _ in walker.nodes(d))


@SLOW
@given(DOCUMENTS, st.booleans(), st.booleans())
def test_masking(events, docs, ascii_only, bounded):
    docs = [d for d in docs if _encodable(d)]
    limits = Limits() if bounded else Limits(enabled=False)
    privacy = Privacy(secret_scan=True)
    rows = gov.redact_events(events(*(walker.dumps(d, ascii_only) for d in docs)), privacy, limits)
    blocked = {walker.normal(k) for k in DEFAULT_BLOCKLIST}
    for row in rows.select("n", "raw").collect():
        assert json.loads(row.raw) == walker.masked(docs[row.n], blocked, True), row.raw


def test_masking_below_the_pattern_depth(events):
    deep = '{"a":' * 90 + '{"token":' + "[" * 80 + "1" + "]" * 80 + ',"b":"Bearer abcdefghijklmnop"}' + "}" * 90
    row = gov.redact_events(events(deep), Privacy(), Limits(enabled=False)).first()
    blocked = {walker.normal(k) for k in DEFAULT_BLOCKLIST}
    assert json.loads(row.raw) == walker.masked(json.loads(deep), blocked, True)


def test_long_texts_do_not_overflow(events):
    big = walker.dumps({"password": "x" * 300_000, "list": [{"token": i} for i in range(3000)], "b": 'y\\"' * 50_000})
    row = gov.redact_events(events(big), Privacy(), Limits(enabled=False)).first()
    doc = json.loads(row.raw)
    assert doc["password"] == "[REDACTED]" and {m["token"] for m in doc["list"]} == {"[REDACTED]"}


@pytest.mark.parametrize("text, valid", [
    ('{"a":1}', True), ('{"a":1} x', False), ('{"a":1}{"b":2}', False), ('{"a":1},{"b":2}', False), ("{bad", False),
    ('{"a":1}] [', False), ('{"a":01}', False), ("[1]", True), ('"x"', True), ('{"a":"\\u0070"}', True), ("", False),
])
def test_strict_json(events, text, valid):
    assert events(text).select(jt.strict_json(F.col("raw")).isNotNull()).first()[0] is valid


def test_last_repeated_key_wins(events):
    row = gov.redact_events(events('{"a":1,"a":"z","token":1,"token":{"x":[1]}}'), Privacy()).first()
    assert json.loads(row.raw) == {"a": "z", "token": "[REDACTED]"}


@pytest.mark.parametrize("path", ["", "user..id", "user.", ".user", "user[abc]", "user[]", "user]", "user[-1]", " . "])
def test_bad_paths(path):
    with pytest.raises(ValueError):
        segments(path)


def test_path():
    assert variant_path(segments("checkpoints[1].name")) == "$['checkpoints'][1]['name']"


def test_limits(events):
    texts = [
        walker.dumps({f"k{i}": i for i in range(513)}), walker.dumps({f"k{i}": i for i in range(512)}),
        '{"d":' * 16 + "1" + "}" * 16, '{"d":' * 15 + "1" + "}" * 15,
        walker.dumps({"a": [{"b": "é" * 8193}]}), walker.dumps({"a": "é" * 8192}), walker.dumps({"k" * 20000: 1}),
        walker.dumps({"big": ["x" * 10000] * 27}),
    ]
    rows = gov.govern(events(*texts), Settings()).orderBy("n").collect()
    assert [r.code for r in rows] == ["attr_count_exceeded", None, "attr_depth_exceeded", None, "string_too_long", None,
                                      None, "event_too_large"]
    assert rows[4].message == "field a[0].b exceeds max_string_length (16386 > 16384)"
    assert rows[0].message == "event field count exceeds max_attr_count (513 > 512)"
    assert rows[5].raw == texts[5]


def test_too_large_after_rewriting(events):
    text = '{"event":"e","event_type":"x","service":"' + "s" * 60 + '"}'
    bound = Identity(allow_payload_identity=False, workspace_id="w" * 80)
    settings = Settings(identity=bound, limits=Limits(max_event_bytes=120))
    row = gov.govern(events(text), settings).first()
    assert row.code == "event_too_large_after_governance" and row.raw == text


def test_aliases_contract_and_objects(events):
    rows = gov.govern(events(
        '{"event_type":"checkout.request"}', '{"event":" ","event_type":"b"}', '{"event":"a","event_type":1}',
        '{"event":3,"event_type":" "}', '{"schema_version":"v2"}', '{"schema_version":2,"event_version":"v9"}', "123",
    )).orderBy("n").collect()
    assert [r.code for r in rows] == [None, None, None, None, "unsupported_schema_version",
                                      "unsupported_event_version", "expected_json_object"]
    assert [r.raw for r in rows[:4]] == ['{"event":"checkout.request"}', '{"event":"b"}', '{"event":"a"}',
                                         '{"event":3,"event_type":" "}']


def test_identity(events):
    bound = Identity(allow_payload_identity=False, service_name="s", environment="prod", tenant_id="t", workspace_id="w")
    row = gov.govern(events('{"tenant":{"id":"x","plan":"p"},"deployment":"odd","workspace":{"id":1,"z":2}}'),
                     Settings(identity=bound)).first()
    assert json.loads(row.raw) == {
        "tenant": {"id": "t", "plan": "p"}, "deployment": {"environment": "prod"}, "workspace": {"id": "w"},
        "service": "s", "service_identity": {"name": "s"}}
    kept = gov.govern(events('{"service":"mine"}'), Settings(identity=Identity(service_name="s"))).first()
    assert kept.raw == '{"service":"mine"}'


def processed(events, text, **privacy):
    row = redact_processor(gov.parse_events(events(text)), Privacy(**privacy)).first()
    return json.loads(row.raw)


def test_processor_blocklist(events):
    text = '{"user":{"email":"e","name":"n"},"auth":{"password":"p","x.Email":1},"users":[{"password":1},[{"password":2}]]}'
    assert processed(events, text, blocklist=("email", "password")) == {
        "user": {"email": "[REDACTED]", "name": "n"}, "auth": {"password": "[REDACTED]", "x.Email": "[REDACTED]"},
        "users": [{"password": "[REDACTED]"}, [{"password": "[REDACTED]"}]]}
    assert processed(events, text, blocklist=("user.*",))["user"] == {"email": "[REDACTED]", "name": "[REDACTED]"}
    assert processed(events, text, blocklist=("USER.email",))["user"] == {"email": "[REDACTED]", "name": "n"}


def test_processor_allowlist(events):
    text = '{"name":"n","age":1,"email":"e","ssn":"s","in":{"name":"x"}}'
    assert processed(events, text, allowlist=("name", "age")) == {
        "name": "n", "age": 1, "email": "[REDACTED]", "ssn": "[REDACTED]", "in": "[REDACTED]"}


def test_patterns(spark):
    rows = spark.createDataFrame([("user.email", "email"), ("user.name", "name"), ("admin.email", "email")], "p string, k string")
    got = rows.select(match_pattern(F.col("p"), F.col("k"), ("user.*",))).collect()
    assert [r[0] for r in got] == [True, True, False]


def test_redaction_audit(events):
    rows = events('{"email":1,"ssn":2,"name":3,"password":{"email":4}}')
    found = redaction_audit(rows, Privacy(blocklist=("email", "ssn", "password")), ("n",)).collect()
    assert sorted(r.field for r in found) == ["email", "password", "ssn"]


def test_outline_does_not_grow_with_members(events):
    wide = "{" + ",".join(f'"k{i}":"a,{{\\"[{i}"' for i in range(600)) + ',"d":{"e":[[],{}]}}'
    rows = events(wide, "5", "{}", '{"a":{}}', '[{},{"b":1}]')
    got = {r.n: (r.o, r.d) for r in rows.select("n", jt.outline(F.col("raw")).alias("o"), jt.max_depth(F.col("raw")).alias("d")).collect()}
    assert got == {0: ("((}((}((}(}(}}}}", 4), 1: ("(}", 1), 2: ("(}", 1), 3: ("((}(}}", 2), 4: ("((}(}((}}}", 3)}


def test_spaces_are_trimmed_around_events(events):
    got = gov.parse_events(events('{"a":1}', '\u2003{"a":1}', '{"a":1}\u00a0\n', '{"a":1} x', None, "")).select("n", "raw", F.to_json("doc").alias("d"))
    assert {r.n: (r.raw, r.d) for r in got.collect()} == {
        0: ('{"a":1}',) * 2, 1: ('{"a":1}',) * 2, 2: ('{"a":1}',) * 2, 3: ('{"a":1} x', None), 4: (None, None), 5: ("", None)}
