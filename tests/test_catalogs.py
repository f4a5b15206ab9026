"""Catalogs as a data source, and shapes compiled to columns."""

from __future__ import annotations

import json
import os
import random

import pytest

from sitegrain.functions import shapes
from sitegrain.sources import catalogs


@pytest.fixture()
def loaders(tmp_path, monkeypatch):
    (tmp_path / "own_catalogs.py").write_text(
        "def healthy(context, n=3, pathname=None):\n"
        "    for k in range(n):\n"
        "        if pathname in (None, f'/p{k}'):\n"
        "            yield {'pathname': f'/p{k}', 'title': f'T{k}' if k % 2 else 7, 'dates': {'published': '2024-01-02'}, 'site': context.get('site')}\n"
        "def throws(context):\n"
        "    yield {'pathname': '/never'}\n"
        "    raise RuntimeError('no database')\n"
        "def odd(context):\n"
        "    return [{'pathname': '/p1'}, {'pathname': '../x'}, 'text', {'title': 'no path'}, {'pathname': '/q', 'dates': {'modified': 'soon'}}]\n"
        "nothing = 3\n"
    )
    (tmp_path / "broken_catalog.py").write_text("def list_pages(:\n")
    return str(tmp_path)


@pytest.fixture()
def known(spark, loaders, monkeypatch):
    """Workers find the modules: the folder is put on their path by a module of ours that they import."""
    monkeypatch.syspath_prepend(loaders)
    spark.sparkContext.addPyFile(f"{loaders}/own_catalogs.py")
    spark.sparkContext.addPyFile(f"{loaders}/broken_catalog.py")
    return [
        {"name": "a", "loader": "own_catalogs:healthy", "args": {"n": 4}}, {"name": "b", "loader": "own_catalogs:throws"}, {"name": "c", "loader": "broken_catalog"},
        {"name": "d", "loader": "own_catalogs:nothing"}, {"name": "e", "loader": "own_catalogs:odd"}, {"name": "f", "loader": "no_such_module:x"},
    ]


def test_failures_are_rows(spark, known):
    kept, found = catalogs.load(spark, "s", known, {"site": "x"})
    rows = {r.pathname: r for r in kept.collect()}
    assert set(rows) == {"/p0", "/p1", "/p2", "/p3", "/q"} and rows["/p1"].title == "T1" and rows["/p0"].title is None
    assert rows["/p1"].published.startswith("2024-01-02") and rows["/q"].modified is None
    codes = sorted(r.code for r in found.collect())
    assert codes == sorted(["catalog-load-failed"] * 3 + ["catalog-missing-list-pages"] + ["catalog-invalid-pathname"] * 3 + ["catalog-path-conflict", "catalog-invalid-date"])


def test_filters_reach_the_catalogs(spark, known):
    some = lambda where: catalogs.listed(spark, known, where=where)
    assert some("catalog = 'a'").rdd.getNumPartitions() == 1 and some("catalog IN ('a', 'e')").rdd.getNumPartitions() == 2
    assert some("catalog = 'a' AND catalog = 'b'").count() == 0
    assert [r.row_ord for r in some("catalog = 'a' AND pathname = '/p2'").collect()] == [0]  # the function saw the path
    df = catalogs.listed(spark, known)
    assert [r.row_ord for r in df.where("catalog = 'a' AND pathname = '/p2'").collect()] == [2]
    assert df.rdd.getNumPartitions() == 6 and df.where("code IS NOT NULL").count() == 4


def test_reader_in_this_process(loaders, monkeypatch):
    monkeypatch.syspath_prepend(loaders)
    reader = catalogs._Reader({"catalogs": json.dumps([{"name": "b", "loader": "own_catalogs:throws"}])})
    got = list(reader.read(reader.partitions()[0]))
    assert [r[5] for r in got] == [None, "catalog-load-failed"] and "no database" in got[1][6]
    assert list(catalogs._Reader({}).partitions()) == []


def test_json_lines(tmp_path):
    os.makedirs(tmp_path / "c/in")
    (tmp_path / "c/in/part-1").write_text('{"pathname": "/a"}\n{"pathname": "/b"}\n')
    (tmp_path / "c/_SUCCESS").write_text("")
    assert [p["pathname"] for p in catalogs.json_lines({}, str(tmp_path / "c"))] == ["/a", "/b"]
    assert [p["pathname"] for p in catalogs.json_lines({}, str(tmp_path / "c"), pathname="/b")] == ["/b"]


def check(shape, value, pointer=""):
    """The same by plain Python."""
    kind = shape.kind
    if kind == "text":
        return None if isinstance(value, str) else pointer
    if kind == "flag":
        return None if isinstance(value, bool) else pointer
    if kind == "number":
        return None if isinstance(value, (int, float)) and not isinstance(value, bool) else pointer
    if kind == "either":
        return None if any(check(s, value) is None for s in shape.of) else pointer
    if kind == "array":
        if not isinstance(value, list):
            return pointer
        return next((p for p in (check(shape.of[0], v, f"{pointer}/{k}") for k, v in enumerate(value)) if p is not None), None)
    if not isinstance(value, dict):
        return pointer
    for key, inner in shape.fields.items():
        if key not in value:
            if key in shape.required:
                return f"{pointer}/{key}"
        elif (p := check(inner, value[key], f"{pointer}/{key}")) is not None:
            return p
    return None


def test_shapes_against_plain_python(spark):
    rng = random.Random(2)
    shape = shapes.record(("a",), a=shapes.text(), b=shapes.array(shapes.record(c=shapes.flag(), d=shapes.array(shapes.number()))), e=shapes.either(shapes.text(), shapes.array(shapes.text())))

    def value(depth=0):
        k = rng.random()
        if depth > 3 or k < 0.4:
            return rng.choice(["x", "", 1, 2.5, True, None])
        if k < 0.6:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {key: value(depth + 1) for key in rng.sample("abcde", rng.randint(0, 4))}

    good = lambda: {"a": "x", "b": [{"c": True, "d": [1, 2.5]}, {}][: rng.randint(0, 2)], "e": rng.choice(["y", ["y", "z"], []])}
    rows = [value() for _ in range(300)] + [good() | ({rng.choice("abe"): value(1)} if rng.random() < 0.7 else {}) for _ in range(500)]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(rows)], "k int, j string")
    got = {r.k: r.p for r in df.select("k", shapes.fault(shape, shapes.parsed(df.j)).alias("p")).collect()}
    assert got == {k: check(shape, v) for k, v in enumerate(rows)} and sum(p is None for p in got.values()) > 100
    broken = spark.createDataFrame([("{",), (None,)], "j string")
    assert [r.p for r in broken.select(shapes.fault(shape, shapes.parsed(broken.j)).alias("p")).collect()] == ["", ""]


def test_descriptors_and_claims(spark):
    whole = {
        "pathname": "/a", "title": "T", "rendering": "on-demand", "dates": {"published": "2024-02-03", "modified": "2024-02-03T04:05:06Z"}, "authors": ["https://e/a", {"@id": "https://e/b"}, {"@type": "Person"}],
        "entities": [{"@id": "x", "@type": ["A", "B"]}], "directives": {"index": True}, "source": {"kind": "cms"}, "more": None,
    }
    cases = [({}, None), ({"pathname": "a"}, "/pathname"), ({"pathname": 3}, "/pathname"), ({"rendering": "never"}, "/rendering"), ({"title": None}, "/title"), ({"dates": []}, "/dates"), ({"dates": {"modified": "2024-13-01"}}, "/dates/modified"),
             ({"authors": ["x", {"name": "y"}]}, "/authors/1"), ({"entities": [{"@id": "x"}]}, "/entities/0/@type"), ({"entities": [{"@type": []}, {"@type": [1]}]}, "/entities/1/@type"), ({"directives": {"index": "yes"}}, "/directives/index"), ({"source": {"path": "x"}}, "/source/kind")]
    df = spark.createDataFrame([(k, json.dumps(whole | c)) for k, (c, _) in enumerate(cases)], "k int, j string")
    got = {r.k: r.p for r in df.select("k", shapes.fault(shapes.DESCRIPTOR, shapes.parsed(df.j)).alias("p")).collect()}
    assert got == {k: p for k, (_, p) in enumerate(cases)}
    claims = spark.createDataFrame([('{"claimId":"c","pathname":"/x","contentType":"text/plain; charset=utf-8"}',), ('{"claimId":"","pathname":"/x"}',), ('{"claimId":"c","pathname":"/x","contentType":"text"}',)], "j string")
    assert [r.p for r in claims.select(shapes.fault(shapes.CLAIM, shapes.parsed(claims.j)).alias("p")).collect()] == [None, "/claimId", "/contentType"]
