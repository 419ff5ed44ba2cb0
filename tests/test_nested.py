import json
import random

import pytest

from textlake.operators import nested as N


def merge(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}
    return a + b if isinstance(a, list) and isinstance(b, list) else b


def differences(a, b, path=()):
    if isinstance(a, dict) and isinstance(b, dict):
        return {d for k in a.keys() & b.keys() for d in differences(a[k], b[k], (*path, k))}
    shown = [x.strip() if isinstance(x, str) else json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False) for x in (a, b)]
    return {".".join(path)} if shown[0] != shown[1] else set()


def value(r, depth=0):
    kind = r.random()
    if depth < 5 and kind < 0.45:
        return {r.choice("abcd"): value(r, depth + 1) for _ in range(r.randint(0, 4))}
    if depth < 5 and kind < 0.6:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return r.choice([None, True, 1, -7, "x", " x ", "é漢", 'q"\\\n', "long " * r.randint(1, 60)])


@pytest.fixture(scope="module")
def values():
    r = random.Random(5)
    return [({"t": value(r), "u": {"v": value(r)}}, {"t": value(r), "u": {"v": value(r), "w": 1}}) for _ in range(60)] + [(value(r), value(r)) for _ in range(20)]


def test_deep_merge(spark, values):
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(values)]
    rows += [(900, "no json", '{"a": 1}'), (901, '{"a": 1}', "a note"), (902, '{"_notes": ["x"]}', "a note"), (903, None, "[1]"), (904, "[1]", None), (905, None, None), (906, "[1]", "text"), (907, "{}", "{}")]
    got = {r.id: r.value for r in N.merged(spark.createDataFrame(rows, "id long, old string, new string"), "id", "old", "new").collect()}
    for i, (a, b) in enumerate(values):
        assert json.loads(got[i]) == merge(a, b)
    assert got[900] == 'no json\n{"a": 1}' and got[905] is None
    assert [json.loads(got[i]) for i in (901, 902, 903, 904, 906, 907)] == [{"a": 1, "_notes": ["a note"]}, {"_notes": ["x", "a note"]}, [1], [1], "text", {}]
    assert N.merged(spark.createDataFrame([], "id long, old string, new string"), "id", "old", "new").count() == 0


def test_conflicts(spark, values):
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(values)]
    got = {}
    for r in N.conflicts(spark.createDataFrame(rows, "id long, old string, new string"), "id", "old", "new").collect():
        got.setdefault(r.id, set()).add(r.path)
    assert got == {i: d for i, (a, b) in enumerate(values) if (d := differences(a, b))}


def shape(x):
    return {k: shape(v) for k, v in x.items()} if isinstance(x, dict) else [shape(v) for v in x] if isinstance(x, list) else "s" if isinstance(x, str) else x


@pytest.mark.parametrize("budget", [2, 40, 150, 400])
def test_shrinking_stays_within_the_budget(spark, values, budget):
    rows = [(i, json.dumps(a)) for i, (a, _) in enumerate(values)] + [(900, "no json " * 40), (901, None), (902, json.dumps({"a": "x" * 300, "b": "y" * 300, "c": "short"}))]
    got = {r.id: r.value for r in N.shrunk(spark.createDataFrame(rows, "id long, v string"), "id", "v", budget).collect()}
    assert set(got) == {i for i, _ in rows} - {901} and all(len(v) <= budget for v in got.values())
    whole = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    for i, (a, _) in enumerate(values):
        own = json.loads(got[i])
        if len(whole(a)) <= budget:
            assert own == a
        elif isinstance(own, (dict, list)):
            assert shape(own) == shape(a)
    if budget >= 150:
        own = json.loads(got[902])
        assert own["c"] == "short" and len(own["a"]) == len(own["b"]) and budget - len(got[902]) <= 2
