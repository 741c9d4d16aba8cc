"""The token machine against Python's JSON decoder."""

import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from eventloom.config import Privacy
from eventloom.functions import jsontext as jt, tokens
from eventloom.operators import governance as gov, redaction
from eventloom.operators.nodes import json_nodes
from eventloom.operators.redaction import redact_processor
from eventloom.sources.payloads import parse_payloads
import walker

sys.setrecursionlimit(20_000)


def made(rng, depth=0):
    kind = rng.random()
    if depth < 6 and kind < .35:
        return {rng.choice(["a", "b.c", "", 'q"', "é", "k\\", "secret"]) + str(i): made(rng, depth + 1) for i in range(rng.randint(0, 4))}
    if depth < 6 and kind < .6:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([1, -2.5e10, True, None, "", "x", 'br{ack"et]', "a,b:c", "\\", "ü😀", "\u0001"])


def spaced(rng, text):
    """The same JSON with white space between its tokens."""
    out, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
            out.append(c)
            continue
        gap = rng.choice(["", "", " ", "\n\t"]) if c in '{}[],:"' else ""
        quoted = c == '"'
        out.append(gap + c + (rng.choice(["", " "]) if c in "{}[],:" else ""))
    return "".join(out).strip()


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(17)
    docs = [{"d": made(rng), "e": made(rng)} for _ in range(150)]
    return docs, [spaced(rng, walker.dumps(d, rng.random() < .3)) for d in docs]


def test_nodes(events, documents):
    docs, texts = documents
    assert [json.loads(t) for t in texts] == docs
    got = {}
    for r in json_nodes(events(*texts), keep=("n",), containers=True).collect():
        got.setdefault(r.n, []).append((r.path, json.dumps(json.loads(r.value))))
    want = {i: sorted((path, json.dumps(value)) for path, value in walker.nodes(d)) for i, d in enumerate(docs)}
    assert {i: sorted(found) for i, found in got.items()} == want


def test_check(events, documents):
    rng = random.Random(3)
    texts = list(documents[1])
    for text in documents[1]:
        at = rng.randrange(len(text))
        texts += [text[:at] + text[at + 1:], text[:at] + rng.choice('{}[],:"01\\ e-') + text[at:]]
    texts += ["", " ", "nul", "01", "-", "1.", ".5", "1e", "[1 2]", '{"a"}', "[,]", "[1,]", '{"a":1,}', '"\t"', '"\\x"', "{} ", "{}x",
              "[" * 1001 + "]" * 1001, '{"a":' * 2000 + "1" + "}" * 2000, "[" * 10_000 + "]" * 10_000, "[" * 10_001 + "]" * 10_001]

    def expected(text):
        if text.startswith("[" * 10_000):
            return len(text) == 20_000
        try:
            json.loads(text, parse_constant=lambda _: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    rows = events(*texts).select("n", tokens.check(F.col("raw")).alias("c")).collect()
    assert {r.n: r.c.valid for r in rows} == {i: expected(t) for i, t in enumerate(texts)}
    for r in rows:
        if r.c.valid and len(texts[r.n]) < 5000:
            doc = json.loads(texts[r.n], object_pairs_hook=lambda pairs: dict((f"{i}{k}", v) for i, (k, v) in enumerate(pairs)))
            assert (r.c.fields, r.c.depth) == (walker.count(doc), walker.depth(doc))


def test_check_of_runs(events):
    texts = ['[ [ {"a" : [ { "b":{"c" : [ ] } } ] } , {} ] , 1 ] ', '{"a":}', '[{"a":]}', '{"a":{"b":1}]', "[[1]]]", "[[1]", '{"a":{"b":[}}}', '{"a" "b":1}',
             '[{"a":"\\q"}]', '["\x01","b"]', '["a" , {"b":{"c":{}}} , [[[]]]]', "{{}}", '{["a"]}', "[,[]]", '{,"a":1}', '[{"a":1,}]', '[{"a":1 "b":2}]', "[]{}", '{"a":"b":1}',
             '{"a":' * 9_999 + "[]" + "}" * 9_999, '{"a":' * 9_999 + "[1]" + "}" * 9_999, '{"a":' * 9_999 + "[[]]" + "}" * 9_999, '{"a":' * 9_999 + "1" + "}" * 9_999]
    rows = events(*texts).select("n", tokens.check(F.col("raw")).alias("c"))
    assert [r.n for r in rows.collect() if r.c.valid] == [0, 10, 19, 22]
    assert [(r.c.fields, r.c.depth) for r in rows.where("n in (0, 10, 19, 22)").orderBy("n").collect()] == [(3, 7), (2, 4), (9_999, 10_000), (9_999, 10_000)]


def test_deep_texts_are_checked_in_few_steps(events):
    pieces = F.size(F.regexp_extract_all(F.regexp_replace("raw", tokens._EXACT_STRING, '""'), F.lit(tokens._EXACT), F.lit(0)))
    rows = events('{"a":[' * 600 + "]}" * 600, "[" * 900 + "{}" + "]" * 900)
    assert [tuple(r) for r in rows.orderBy("n").select(pieces, jt.max_depth(F.col("raw"))).collect()] == [(2, 1200), (2, 901)]


def test_masks_are_spliced(events, documents):
    docs, texts = documents

    def masked(value, path=""):
        if isinstance(value, dict):
            found = {}
            for key, child in value.items():
                place = f"{path}.{key}" if path else key
                found[key] = "#" if key.startswith("secret") or place == "e.a0" else masked(child, place)
            return found
        return [masked(v, path) for v in value] if isinstance(value, list) else value

    def hidden(path, key, value):
        return F.startswith(key, F.lit("secret")) | (path == "e.a0")

    rows = events(*texts).select("n", tokens.mask_members(F.col("raw"), hidden, '"#"').alias("m")).collect()
    for r in rows:
        assert json.loads(r.m.raw) == masked(docs[r.n])
        assert r.m.paths or r.m.raw == texts[r.n]
    assert any(r.m.paths for r in rows)


def test_plain_rule_says_what_the_columns_say(events, documents):
    odd = ['{"a":[[{"b":{"c":[]}}]],"B" : [ { "x.b":1 } ] , "":{"a":{"":2},"b":[]}}', '[[{"a":{"b":[1]}}],{"c":[[{"b":{}}]]}]  ', "[]", "3", "{}",
           '{"x":{"a":[{"n":{"b":"}]"}}]},"k":{"a.b":{"c":1}}}', '{"\\u0061":1,"b":{"é":2}}']
    rows = events(*documents[1], *odd)
    for rules in (Privacy(allowlist=("a", "b.*", "x.a", "*0")), Privacy(blocklist=("B", "a.c", "e.*", "*.n"))):
        place, plain = redaction._place_rule(rules), redaction._plain_rule(rules)
        both = rows.select("n", tokens.mask_members(F.col("raw"), place, '"#"').alias("a"),
                           tokens.mask_members(F.col("raw"), place, '"#"', plain).alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both] and any(r.a.paths for r in both)


def test_plain_rule_judges_a_path_once():
    seen = []
    masker = tokens._Masker(lambda path, name: seen.append(path) or name == "s", '"#"')
    text = '{"a":' * 500 + '{"s":[{"t":1}]}' + "}" * 500
    assert [masker.masked(text) for _ in range(3)][2] == (text.replace('[{"t":1}]', '"#"'), ["a." * 500 + "s"])
    assert len(seen) == 501


def test_repeated_keys_count_once(events):
    rows = events('{"a":{"x":1},"a":[true],"id":{"id":1}}', '{"\\u0061":1,"a":{"b":2}}', '{"id":{"id":1.50}}', "[1,1]")
    paths = {}
    for r in json_nodes(rows, keep=("n",)).collect():
        paths.setdefault(r.n, set()).add(r.path)
    assert paths == {0: {"", "a", "a[0]", "id", "id.id"}, 1: {"", "a", "a.b"}, 2: {"", "id", "id.id"}, 3: {"", "[0]", "[1]"}}
    assert json_nodes(rows.where("n < 0"), keep=("n",)).count() == 0
    empty = rows.select(F.lit(None).cast("string").alias("raw"))
    assert json_nodes(empty).count() == 0
    assert empty.select(tokens.mask_members(F.col("raw"), lambda *_: F.lit(True), "1").alias("m")).where("m is not null").count() == 0


def test_masking_keeps_digits_and_bytes(events):
    text = '{"n": 0.12345678901234567890123456789012345678901234567890, "deep":' + '{"k": [' * 70 + '{"k":1,"x":2}' + "]}" * 70 + ', "x" : {"k":1}}'
    row = redact_processor(gov.parse_events(events(text)), Privacy(allowlist=("n", "deep", "k"))).first()
    assert row.raw == text.replace('"x":2', '"x":"[REDACTED]"').replace('"x" : {"k":1}', '"x" : "[REDACTED]"')


def test_many_members(events):
    wide = {f"k{i}": {"v": [i, str(i)]} for i in range(6000)}
    nodes = json_nodes(events(json.dumps(wide)), keep=("n",))
    assert nodes.count() == 1 + 6000 * 4


def test_deep_elements_keep_their_bytes(events):
    deep = "[" * 90 + ' {"a" : 1.0} ' + "]" * 90
    rows = parse_payloads(events(f"[ {deep} , 1 ]", '{"events": [%s, {"b" : 2}], "source":{}}' % deep).withColumnRenamed("raw", "payload"))
    assert [r["items"] for r in rows.orderBy("n").collect()] == [[deep, "1"], [deep, '{"b" : 2}']]


def test_deeper_than_parsing(events):
    rows = gov.govern(events("{\"a\":" + "[" * 1100 + "]" * 1100 + "}", "{\"a\":" + "[" * 1100 + "]" * 1099 + "}"), )
    assert [r.code for r in rows.orderBy("n").collect()] == ["attr_depth_exceeded", "expected_json_object"]
