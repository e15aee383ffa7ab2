import json
import random

from pyspark.sql import functions as F

from lodestrata.operators.nested import ADVISORY_PARENTS, _parse_deep, advisory_leaves, advisory_parents, parent_label, parse_json, shred


def leaves(spark, *bodies):
    df = spark.createDataFrame([(n, b, "x") for n, b in enumerate(bodies)], "record_id long, body string, path string")
    return sorted(tuple(r) for r in advisory_leaves(shred(df, "record_id", "body"), "record_id").collect())


def test_shapes(spark):
    record = {"id": "A", "Affected": [None, {"ranges": {"events": [{"Introduced": 0}, None, {"fixed": "1.0", "note": {"events": [{"fixed": "9"}]}}]}, "versions": "[\"2\", null, \"\"]", "ecosystem_specific": {"ranges": [{"events": [{"introduced": "7"}]}]}}], "database_specific": {"affected": [{"versions": ["z"]}]}}
    want = [(0, 1, "fixed", 0, 2, "1.0"), (0, 1, "introduced", 0, 0, "0"), (0, 1, "version", -1, 0, "2")]
    assert leaves(spark, json.dumps(record)) == want
    assert leaves(spark, json.dumps({"data": {"record": record}, "etag": "x"})) == want
    assert leaves(spark, json.dumps([{"payload": record}])) == want


def test_bad_and_empty(spark):
    deep = "[" * 5000 + "]" * 5000
    assert leaves(spark, None, "", "null", "{", '{"affected": [{"versions": ["1"]', '{"affected": NaN}', '{"id": 1}', '{"affected": "x"}', '{"affected": [3, "y"]}', deep, '{"database_specific": {"affected": [{"versions": ["1"]}]}}') == []


def test_bare_values_and_numbers(spark):
    assert leaves(spark, '{"affected": {"versions": 1.50}}') == [(0, 0, "version", -1, 0, "1.50")]
    assert leaves(spark, '{"affected": {"versions": ["\\ud800", "\\u00e9"]}}') == [(0, 0, "version", -1, 0, "?"), (0, 0, "version", -1, 1, "é")]
    assert leaves(spark, '{"affected": {"versions": "1.2"}}') == [(0, 0, "version", -1, 0, "1.2")]
    assert leaves(spark, json.dumps({"affected": json.dumps([{"ranges": json.dumps([{"events": json.dumps({"last_affected": "3"})}])}])})) == [(0, 0, "last_affected", 0, 0, "3")]


def test_labels_truncate_to_parents(spark):
    df = spark.createDataFrame([(1, '{"id": 1, "affected": [{"versions": ["a", "b"]}]}')], "record_id long, body string")
    got = shred(df, "record_id", "body").select("dewey", parent_label(F.col("dewey")).alias("p")).collect()
    assert len(got) == 2 and all(r.p == r.dewey[:-1] for r in got) and len({tuple(r.p) for r in got}) == 1
    assert shred(df.limit(0), "record_id", "body").count() == 0


def test_missing_keys(spark):
    df = spark.createDataFrame([(None, '{"affected": [{"versions": ["1"]}]}'), (2**60 + 1, '{"affected": [{"versions": ["1"]}]}')], "record_id long, body string")
    assert [r.record_id for r in shred(df, "record_id", "body").collect()] == [2**60 + 1]


def test_any_depth(spark):
    record = '{"affected": [{"versions": ["1", {"x": "' + "y" * 10 + '"}], "deep": ' + "[" * 60_000 + "]" * 60_000 + "}]}"
    assert leaves(spark, record) == [(0, 0, "version", -1, 0, "1")]
    assert leaves(spark, '{"a": ' * 30_000 + record + "}" * 30_000) == [(0, 0, "version", -1, 0, "1")]


def test_deep_parser_agrees():
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        return [None, True, rng.choice([0, -1.5, 2e30, 12]), 'é"\\\n', rng.choice(["", "x"])][kind] if kind < 5 else [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 5 else {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))}

    texts = [json.dumps(value(5), ensure_ascii=bool(rng.randrange(2)), indent=rng.choice([None, 1])) for _ in range(300)]
    bad = ["", "[", "[1,]", '{"a" 1}', '{"a":}', "[1 2]", "1 2", "{,}", '{"a":1,}', "]", "tru", "01", '"x', "[1}", "NaN", "-", '{1:2}', "[] x", "1.", "+1"]
    for t in texts + bad:
        outcome = []
        for parse in (parse_json, _parse_deep):
            try:
                outcome.append(parse(t))
            except ValueError:
                outcome.append("bad")
        assert outcome[0] == outcome[1] and (outcome[0] == "bad") == (t in bad), t


def test_parents_without_leaves(spark):
    df = spark.createDataFrame([(1, '{"affected": [{"package": {}}, null, {"ranges": [{"events": []}, null, {"type": "X"}]}, "x"]}'), (2, "{"), (3, None)], "record_id long, body string")
    got = advisory_parents(shred(df, "record_id", "body", (), parents=ADVISORY_PARENTS), "record_id").collect()
    assert sorted(((r.affected_no, r.range_no) for r in got), key=repr) == [(0, None), (2, 0), (2, 2), (2, None)]
