"""User texts of JSON bodies: what the walk reads, and bodies that must neither stop a job nor pass unredacted."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwork.functions.jsonspans import user_texts
from maskwork.operators import bodies as B

SSN = "ssn 123-45-6789"
DEEP = "[" * 3000 + "]" * 3000


def texts(body):
    got = user_texts(body)
    return None if got is None else [t.text for t in got]


@pytest.mark.parametrize("body, want", [
    ('{"messages":[{"Role":"user","CONTENT":"a"},{"role":"assistant","content":"b"}]}', ["a"]),
    ('{"messages":[{"role":"assistant","ROLE":"user","content":"a","Content":"b"}]}', ["b"]),
    ('{"messages":[{"role":"user","Role":null,"content":"a"},{"role":"user","Role":5,"content":"b"}]}', ["a"]),
    ('{"Messages":[{"role":"user","content":"a"}]}', []),
    ('{"messages":[{"role":"user","content":"a"}],"messages":[{"role":"user","content":"b"}]}', ["b"]),
    ('{"messages":[{"role":"user","content":"a"}],"messages":7}', []),
    ('{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"Type":"text","text":"b"},{"type":"image","text":"c"}]}]}', ["a"]),
    ('{"messages":[{"role":"user","content":null},{"role":"user"},{"role":"user","content":5}]}', ["", ""]),
    ('{"n":' + "9" * 5000 + ',"x":1e99999,"messages":[{"role":"user","content":"a","k":' + "1" * 5000 + "}]}", ["a"]),
    ('{"x":' + DEEP + ',"messages":[{"role":"user","content":"a","meta":' + DEEP + "}]}", ["a"]),
    ('{"messages":[{"role":"user","content":[{"type":"text","text":"a","meta":' + DEEP + "}]}]}", ["a"]),
    ('{"messages":[{"role":"user","content":"\\ud83d a \\ude00 \\ud83d\\ude00"}]}', ["� a � \U0001f600"]),
    ('{"x":' + "[" * 10_001 + "]" * 10_001 + "}", None),
    ('{"x":' + "[" * 3000 + "]" * 2999 + "}", None),
    ('{"a":NaN}', None), ('{"a":1,}', None), ('{"a":1} x', None), ("", None), (None, None), ("[1, 2]", []), ('"text"', []),
])
def test_texts(body, want):
    assert texts(body) == want


def test_agrees_with_the_json_module_on_damaged_bodies():
    rng = random.Random(4)
    base = json.dumps({"m": 1, "messages": [{"role": "user", "content": 'é "q" \n'}, {"role": "user", "content": [{"type": "text", "text": "b"}, [1, -2.5e3, {}]]}]})
    for _ in range(20_000):
        at = rng.randrange(len(base))
        body = base[:at] + rng.choice(["", *'"{}[],:1-e.\\ t']) + base[at + rng.randrange(2) :]
        try:
            json.loads(body)
            valid = True
        except ValueError:
            valid = False
        got = user_texts(body)
        assert (got is not None) == valid
        for t in got or []:
            assert t.start < 0 or json.loads(body[t.start : t.end]) == t.text


def test_bodies_that_used_to_stop_the_job_or_leak(spark):
    rows = [
        (1, '{"messages":[{"role":"user","content":"\\ud83d ' + SSN + '"}],"n":"\\ud83d"}'),
        (2, '{"n":' + "7" * 5000 + ',"messages":[{"role":"user","content":"' + SSN + '"}]}'),
        (3, '{"messages":[{"Role":"user","Content":"' + SSN + '"}]}'),
        (4, '{"x":' + DEEP + ',"messages":[{"role":"user","content":"' + SSN + '"}]}'),
        (5, '{"messages":[{"role":"user","content":"\\ud83d fine"}]}'),
        (6, "not json " + SSN), (7, None)]
    df = spark.createDataFrame(rows, "request_id bigint, body string")
    found = B.body_findings(B.body_texts(df, "request_id", "body"), "request_id").withColumn("action", F.lit("redact_one_way"))
    out = {r.request_id: (r.body, r.parsed) for r in B.redact_json_bodies(df, "request_id", "body", found, "s").collect()}
    for i in (1, 2, 3, 4):
        assert "123-45" not in out[i][0].replace("123-**", "") and out[i][1]
        json.JSONDecoder(parse_int=str) if i == 4 else json.loads(out[i][0], parse_int=str)
    assert "� ssn 123-**-****" in out[1][0] and '"n":"\\ud83d"' in out[1][0]
    assert out[2][0].startswith('{"n":' + "7" * 5000) and '"Content":"ssn 123-**-****"' in out[3][0]
    assert out[5] == (rows[4][1], True) and out[6] == (rows[5][1], False) and out[7] == (None, False)


def test_bodies_are_decoded_a_few_at_a_time(spark):
    batches = list(B._small([pa.RecordBatch.from_pydict({"x": list(range(600))})]))
    assert [b.num_rows for b in batches] == [256, 256, 88] and [x for b in batches for x in b.column(0).to_pylist()] == list(range(600))
    rows = spark.range(600).coalesce(1).select("id", F.lit('{"messages":[{"role":"user","content":"a"}]}').alias("body"))
    sizes = B.body_texts(rows, "id", "body").groupBy("id", "text").count().collect()
    assert len(sizes) == 600 and {(r.text, r["count"]) for r in sizes} == {("a", 1)}
