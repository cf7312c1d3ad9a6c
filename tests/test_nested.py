"""Documents of any depth against a walk in Python."""

import json
import random

import pytest

from quillspark.operators import nested


def leaves(value, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, {None: None, True: "true", False: "false"}.get(value, str(value)) if not isinstance(value, (int, str)) or isinstance(value, bool) else str(value)


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.2:
        return rng.choice([1, -70, "x", "", "a [{ \" \\ } b", "é\n", None, True, False])
    if kind < 0.6:
        return {rng.choice("abcdefgh") + str(i): made(rng, depth - 1) for i in range(rng.randint(0, 3))}
    return [made(rng, depth - 1) for _ in range(rng.randint(0, 3))]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    return {i: made(rng, i % 8) for i in range(80)} | {90: [[[[["deep"]]]]], 91: "only", 92: {}, 93: []}


def frame(spark, rows):
    return spark.createDataFrame(list(rows), "key int, doc string").selectExpr("*", "1 as path", "2 as value", "3 as pos")


def test_walk(spark, docs):
    rows = [(i, json.dumps(d)) for i, d in docs.items()] + [(100, None), (101, ""), (102, "{"), (103, '{"a": 1, "a": 2}'), (104, "]]]")]
    got = sorted((r.key, r.path, r.value or "") for r in nested.walk(frame(spark, rows), "key", "doc").collect())
    assert got == sorted((i, p, v or "") for i, d in docs.items() for p, v in leaves(d))


def test_long_strings_and_many_escapes(spark):
    text = '"\\\n[{' * 50_000
    assert nested.walk(frame(spark, [(1, json.dumps({"a": [text]}))]), "key", "doc").collect() == [(1, "$.a[0]", text)]


def test_diff(spark, docs):
    other = dict(docs)
    other[90] = [[[[["shallow"]], 3]]]
    other[91] = None
    other[200] = {f"k{i}": i for i in range(25)}
    del other[5]
    got = {}
    for r in nested.diff(*(frame(spark, [(i, json.dumps(d)) for i, d in some.items()]) for some in (docs, other)), "key", "doc").orderBy("key", "r").collect():
        got.setdefault(r.key, []).append((r.path, r.before, r.after, r.changes))
    want = {}
    for i in docs.keys() | other.keys():
        a, b = (dict(leaves(some[i])) if i in some else {} for some in (docs, other))
        paths = sorted(p for p in a.keys() | b.keys() if (p in a) != (p in b) or a.get(p) != b.get(p))
        if paths:
            want[i] = [(p, a.get(p), b.get(p), len(paths)) for p in paths[:10]]
    assert got == want and len(got[200]) == 10


def test_no_documents(spark):
    assert nested.walk(frame(spark, []), "key", "doc").count() == 0
