from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from sitegrain.functions import graph as G


def page(**more):
    return {"@type": "WebPage", "@id": "https://e.com/", **more}


def test_merge_by_id_and_policy():
    for policy, name in (("error", "a"), ("first", "a"), ("last", "b")):
        m = G.merge([page(name="a"), page(name="b", url="/x")], policy)
        assert len(m.entries) == 1 and m.entries[0]["entity"]["name"] == name and m.entries[0]["entity"]["url"] == "/x"
        assert m.conflicts[0]["resolution"] == ("unresolved" if policy == "error" else policy)


def test_anonymous_types_and_arrays():
    m = G.merge([{"@type": "T"}, {"@type": "T"}, page(l=[1, 2, {"@id": "x", "a": 1}]), {"@type": ["WebPage", "B"], "@id": "https://e.com/", "l": [2, 3, {"@id": "x", "b": 2}]}])
    assert len(m.entries) == 2
    assert m.entries[1]["entity"] == {"@type": ["WebPage", "B"], "@id": "https://e.com/", "l": [1, 2, {"@id": "x", "a": 1, "b": 2}, 3]}


def test_inferred_yields_to_authored():
    guess = {"entity": {"@type": "WebPage", "@id": "#guess", "name": "g"}, "roles": ["page"], "provenance": [{"source": "inference"}]}
    own = {"entity": {"@type": "WebPage", "@id": "#own", "name": "o"}, "roles": ["page"], "provenance": [{"source": "authored-jsonld"}]}
    for order in ([guess, own], [own, guess]):
        m = G.merge(order)
        assert len(m.entries) == 1 and m.entries[0]["entity"]["@id"] == "#own" and m.entries[0]["entity"]["name"] == "o" and not m.conflicts


def test_validation_findings():
    codes = lambda *a, **k: sorted(f["code"].removeprefix("schema.") for f in G.validate(*a, **k)[1])
    assert codes([page(author={"@id": "#q"})], base="https://e.com/") == ["unresolved-reference"]
    assert codes([page(author={"@id": "#q"}), {"@type": "Person", "@id": "#q"}], base="https://e.com/") == []
    assert codes([page(url="/x")]) == ["relative-url-base-missing"] and codes([page(url="javascript:x")]) == ["unsafe-url"]
    assert codes([page(name="a"), page(name="b")]) == ["scalar-conflict"] and codes([page(name="a"), page(name="b")], policy="last") == ["scalar-conflict-resolved"]
    two = [{"entity": page(), "roles": ["page"]}, {"entity": {"@type": "X", "@id": "https://e.com/2"}, "roles": ["page"]}]
    assert codes(two) == ["duplicate-role"]
    assert codes([page(about={"@id": "https://e.com/z"})], site="https://e.com/", known={"https://e.com/y"}) == ["unresolved-reference"]
    assert codes([page(about={"@id": "https://other.com/z"})], site="https://e.com/", known=set()) == []
    assert codes([5]) == ["invalid-graph"]


def test_strict_json_and_entities():
    for bad in ({"a": float("nan")}, {"__proto__": 1}, {"a": object()}, {"@context": "x"}, {"@type": ""}, {"@id": "a\nb"}, []):
        with pytest.raises(G.GraphError):
            G.entity(bad)
    assert G.build("Person", {"name": "n"}) == {"@type": "Person", "name": "n"}
    assert G.connect({"@type": "A", "k": {"@id": "x"}}, "k", "y")["k"] == [{"@id": "x"}, {"@id": "y"}]
    assert G.connect({"@type": "A", "k": {"@id": "x"}}, "k", "x")["k"] == {"@id": "x"}
    assert G.authored('[{"@type":"A"}, 5]') == ([{"@type": "A"}], ["jsonld-invalid-node"]) and G.authored("{")[1] == ["jsonld-invalid"]
    assert "\\u003c" in G.document(G.merge([{"@type": "A", "t": "</script>"}]))


def test_patch_replays_a_diff():
    a = [page(name="a"), {"@type": "B", "@id": "b"}]
    b = [page(name="x"), {"@type": "C", "@id": "c"}]
    got, bad = G.patch(a, G.diff(a, b))
    assert G.same(got, b) and not bad
    got, bad = G.patch([page(name="other"), a[1]], G.diff(a, b))
    assert bad == ["https://e.com/"]
    got, bad = G.patch([page(name="a", more=1), a[1]], G.diff(a, b))
    assert not bad and {"name": "x", "more": 1}.items() <= next(e["entity"] for e in got if e["entity"]["@id"] == "https://e.com/").items()


def test_reconcile():
    text = '{"@type":"WebPage","@id":"https://e.com/","name":"a"}'
    assert G.reconcile(text, text + " ", [], None, None)[1] == ["managed-graph-authored-changed"]
    got, bad = G.reconcile(text, text, [], None, [page(name="a", more=1)])
    assert not bad and got[0]["entity"] == page(more=1)
    assert G.subtract(page(name="a"), page(name="a")) is None


def test_entries_that_are_no_entities(spark):
    from sitegrain.operators import graphs

    rows = [("s", "/a", 0, '{"@id":"https://e/x","@type":"Thing","name":"n"}'), ("s", "/a", 1, "{"), ("s", "/a", 2, "[1]"), ("s", "/a", 3, None), ("s", "/b", 0, '{"@id":"https://e/x","@type":"Thing","@context":"c"}'), ("s", "/b", 1, '{"@type":"Thing"}')]
    df = spark.createDataFrame(rows, "site string, pathname string, ord int, entity string").selectExpr("*", "array() AS roles", "CAST(NULL AS STRING) AS provenance").withColumn("roles", F.array().cast("array<string>"))
    assert sorted((r.id or "", r.entity) for r in graphs.merge_site(df).collect()) == [("", '{"@type":"Thing"}'), ("https://e/x", '{"@id":"https://e/x","@type":"Thing","name":"n"}')]
    assert {r.pathname: r.id for r in graphs.merge_pages(df).collect()} == {"/a": "https://e/x", "/b": None}
    assert [(r.pathname, r.code) for r in graphs.entry_findings(df).collect()] == [("/a", "schema.invalid-graph")] * 3
