"""Patches by JSON Pointer: the standard's example cases, and a plain implementation on generated ones."""

import copy
import json
import random

from lexmill.operators import patches

RECORDS, PATCHES = "ir_id string, document string", "ir_id string, patch_id string, seq int, op string, path string, from string, value string, approved boolean"
#: The examples of the standard's appendix A: document, operations, result (None: error).
CASES = [
    ({"foo": "bar"}, [("add", "/baz", None, "qux")], {"baz": "qux", "foo": "bar"}), ({"foo": ["bar", "baz"]}, [("add", "/foo/1", None, "qux")], {"foo": ["bar", "qux", "baz"]}),
    ({"baz": "qux", "foo": "bar"}, [("remove", "/baz", None, ...)], {"foo": "bar"}), ({"foo": ["bar", "qux", "baz"]}, [("remove", "/foo/1", None, ...)], {"foo": ["bar", "baz"]}),
    ({"baz": "qux", "foo": "bar"}, [("replace", "/baz", None, "boo")], {"baz": "boo", "foo": "bar"}),
    ({"foo": {"bar": "baz", "waldo": "fred"}, "qux": {"corge": "grault"}}, [("move", "/qux/thud", "/foo/waldo", ...)], {"foo": {"bar": "baz"}, "qux": {"corge": "grault", "thud": "fred"}}),
    ({"foo": ["all", "grass", "cows", "eat"]}, [("move", "/foo/3", "/foo/1", ...)], {"foo": ["all", "cows", "eat", "grass"]}),
    ({"baz": "qux", "foo": ["a", 2, "c"]}, [("test", "/baz", None, "qux"), ("test", "/foo/1", None, 2)], {"baz": "qux", "foo": ["a", 2, "c"]}), ({"baz": "qux"}, [("test", "/baz", None, "bar")], None),
    ({"foo": "bar"}, [("add", "/child", None, {"grandchild": {}})], {"foo": "bar", "child": {"grandchild": {}}}), ({"foo": "bar"}, [("add", "/baz/bat", None, "qux")], None),
    ({"/": 9, "~1": 10}, [("test", "/~01", None, 10)], {"/": 9, "~1": 10}), ({"/": 9, "~1": 10}, [("test", "/~01", None, "10")], None), ({"foo": ["bar"]}, [("add", "/foo/-", None, ["abc", "def"])], {"foo": ["bar", ["abc", "def"]]}),
]
MORE = [
    ({"a": [1, 2]}, [("add", "/a/3", None, 0)], None), ({"a": [1, 2]}, [("add", "/a/01", None, 0)], None), ({"a": [1, 2]}, [("remove", "/a/-", None, ...)], None), ({"a": {"b": 1}}, [("move", "/a/b/c", "/a", ...)], None),
    ({"a": {"b": 1}}, [("move", "/a", "/a", ...)], {"a": {"b": 1}}), ({"a": 1}, [("add", "", None, [1])], [1]), ({"a": {"b": [1]}}, [("copy", "/a/b/0", "/a", ...)], {"a": {"b": [{"b": [1]}, 1]}}), ({"a": 1}, [("test", "/a", None, 1.0)], {"a": 1}),
    ({"a": None}, [("test", "/a", None, None)], {"a": None}), ({"a": {"x": 1, "y": [2]}}, [("test", "/a", None, {"y": [2], "x": 1})], {"a": {"x": 1, "y": [2]}}), ({"é\"\n": "日"}, [("copy", "/b", "/é\"\n", ...)], {"é\"\n": "日", "b": "日"}),
    ({"a": 1}, [("add", "/b", None, 2), ("remove", "/none", None, ...)], None), ({"a": 1}, [("add", "b", None, 2)], None), ({"a": 1}, [("add", "/~2", None, 2)], None), ({"a": 1}, [("mark", "/a", None, 2)], None), ({"a": 1}, [("copy", "/b", None, ...)], None), ({"a": [[0, 1], [2, 3]]}, [("remove", "/a/0/0", None, ...), ("add", "/a/0/0", None, "n"), ("replace", "/a/1", None, {})], {"a": [["n", 1], {}]}),
    ({"": 1, "a/b": 2}, [("replace", "/", None, 3), ("remove", "/a~1b", None, ...)], {"": 3}), ({"a": "x"}, [("add", "/a/b", None, 2)], None), ({"a": 1}, [("remove", "", None, ...)], None),
]


def run(spark, cases):
    records = [(str(i), json.dumps(doc, ensure_ascii=False)) for i, (doc, _, _) in enumerate(cases)]
    rows = [(str(i), "p", k, op, path, origin, None if value is ... else json.dumps(value), True) for i, (_, ops, _) in enumerate(cases) for k, (op, path, origin, value) in enumerate(ops)]
    got = patches.patched(spark.createDataFrame(records, RECORDS), spark.createDataFrame(rows, PATCHES)).collect()
    return {int(r.ir_id): None if r.patch_error else json.loads(r.document) for r in got}


def test_the_standard_s_examples(spark):
    cases = CASES + MORE
    assert run(spark, cases) == {i: want for i, (_, _, want) in enumerate(cases)}


def plain(doc, ops):
    """The same for objects and arrays nested as generated here."""
    box = {"root": copy.deepcopy(doc)}

    def find(path):
        steps, at = ["root", *path.split("/")[1:]], box
        for s in steps[:-1]:
            at = at[int(s)] if isinstance(at, list) else at[s]
        return at, steps[-1]

    def get(path):
        at, k = find(path)
        return at[int(k)] if isinstance(at, list) else at[k]

    def remove(path):
        at, k = find(path)
        return at.pop(int(k) if isinstance(at, list) else k)

    def add(path, value):
        at, k = find(path)
        if isinstance(at, list):
            i = len(at) if k == "-" else int(k)
            if i > len(at):
                raise IndexError
            at.insert(i, value)
        elif isinstance(at, dict):
            at[k] = value
        else:
            raise TypeError

    try:
        for op, path, origin, value in ops:
            if op == "add":
                add(path, value)
            elif op == "remove":
                remove(path)
            elif op == "replace":
                get(path)
                at, k = find(path)
                at[int(k) if isinstance(at, list) else k] = value
            elif op == "copy":
                add(path, copy.deepcopy(get(origin)))
            elif op == "move":
                if path != origin and (path + "/").startswith(origin + "/"):
                    raise ValueError
                get(origin)
                if path != origin:
                    add(path, remove(origin))
    except (KeyError, IndexError, TypeError, ValueError, AttributeError):
        return None
    return box["root"]


def test_against_a_plain_implementation(spark):
    r = random.Random(5)

    def value(depth):
        kind = r.random()
        if depth == 0 or kind < 0.3:
            return r.choice([1, "x", None, True, 2.5])
        return [value(depth - 1) for _ in range(r.randint(0, 3))] if kind < 0.6 else {k: value(depth - 1) for k in r.sample("abc", r.randint(0, 3))}

    def path():
        return "".join(f"/{r.choice(['a', 'b', '0', '1', '2', '-'])}" for _ in range(r.randint(1, 3)))

    cases = []
    while len(cases) < 250:
        doc, ops = {"a": value(3), "b": value(3)}, [(r.choice(["add", "remove", "replace", "copy", "move"]), path(), path(), value(2)) for _ in range(r.randint(1, 3))]
        if any("-" in o[1][:-1] or (o[0] != "add" and "-" in o[1]) or "-" in o[2] for o in ops):
            continue
        cases.append((doc, ops, plain(doc, ops)))
    got = run(spark, cases)
    assert [(i, cases[i]) for i in got if got[i] != cases[i][2]] == []
    assert sum(w is not None for _, _, w in cases) > 25


def test_records_without_patches_and_odd_rows(spark):
    records = spark.createDataFrame([("a", '{"x": 1}'), ("b", "{bad"), ("c", None), ("d", '{"x": 1}'), (None, "{}")], RECORDS)
    rows = [("a", "p", 0, "add", "/y", None, "2", False), ("b", "p", 0, "remove", "/x", None, None, True), ("c", "p", 0, "remove", "/x", None, None, True), ("d", "q", 0, "replace", "/x", None, "3", True), ("d", "p", 1, "remove", "/x", None, None, True), ("d", "p", 0, "copy", "/y", "/x", None, True), ("none", "p", 0, "add", "/x", None, "1", True)]
    got = {r.ir_id: (r.document, r.patch_error) for r in patches.patched(records, spark.createDataFrame(rows, PATCHES)).collect()}
    assert got == {"a": ('{"x": 1}', None), "b": ("{bad", "document"), "c": (None, "document"), "d": ('{"x": 1}', "q"), None: ("{}", None)}
    assert patches.patched(records, spark.createDataFrame([], PATCHES)).where("patch_error IS NOT NULL").count() == 0
