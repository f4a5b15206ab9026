"""Graph views: additions, reconciliation per page, references across pages."""

from __future__ import annotations

import json
import random

import pytest

from sitegrain.functions import envelope
from sitegrain.functions import graph as G
from sitegrain.operators import envelopes

API = [{"source": "api"}]


def entry(value, **more):
    return {"entity": value, "roles": [], "provenance": API} | more


def test_additions():
    old = {"@id": "a", "@type": "Person", "name": "n", "knows": [{"@id": "b"}, "x", "x"], "of": {"@type": "Thing", "k": 1}}
    assert envelope.additions(old, old) is envelope.NOTHING
    new = {"@id": "a", "@type": ["Person", "Author"], "name": "n", "knows": ["x", "x", "x", {"@id": "b", "age": 3}], "of": {"@type": "Thing", "k": 1, "l": 2}, "url": "u"}
    assert envelope.additions(new, old) == {"@id": "a", "@type": "Author", "knows": ["x", {"@id": "b", "age": 3}], "of": {"@type": "Thing", "l": 2}, "url": "u"}
    assert envelope.additions({"@id": "a", "@type": "Person", "name": "other"}, old) == {"@id": "a", "@type": "Person", "name": "other"}
    assert envelope.additions({"@id": "a", "@type": "Person"}, old) is envelope.NOTHING  # removals show in the recombination


def random_value(rng, depth=0):
    kind = rng.random()
    if depth > 2 or kind < 0.5:
        return rng.choice(["x", "y", 1, 2, True, None])
    if kind < 0.75:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {k: random_value(rng, depth + 1) for k in rng.sample("abc", rng.randint(1, 3))}


def test_added_facts_come_back_by_subtraction():
    rng = random.Random(1)
    hits = 0
    for _ in range(3000):
        base = {"@id": "i", "@type": "Thing"} | {k: random_value(rng) for k in rng.sample("pqrs", 2)}
        more = {"@id": "i", "@type": "Thing"} | {k: random_value(rng) for k in rng.sample("pqrs", 2)}
        try:
            whole = envelope.added(base, more)
        except envelope.Conflict:
            continue
        rest = envelope.additions(whole, base)
        assert G.stable(whole if rest is envelope.NOTHING else envelope.added(base, rest)) == G.stable(whole)
        hits += rest is not envelope.NOTHING
    assert hits > 300
    with pytest.raises(envelope.Conflict):
        envelope.added({"a": 1}, {"a": 2})


OWN = [entry({"@id": "https://e/p", "@type": "WebPage", "name": "P"}, provenance=[{"source": "authored"}] if "authored" in G.SOURCES else API)]
OURS = [entry({"@id": "https://e/o", "@type": "Organization", "name": "O"})]


def reconciled(managed=None, whole=None):
    both = envelope.combine(OWN, OURS)
    return envelope.reconcile(OWN, OURS, both, OURS if managed is None else managed, both if whole is None else whole)


def test_one_view_decides_about_the_other():
    both = envelope.combine(OWN, OURS)
    assert reconciled()[2:] == (False, False, None)
    more = [*OURS, entry({"@id": "https://e/q", "@type": "Person", "name": "Q"})]
    managed, whole, first, second, code = reconciled(managed=more)
    assert (first, second, code) == (True, False, None) and len(whole) == 3 and G.same(managed, more)
    managed, whole, first, second, code = reconciled(whole=[*both, more[-1]])
    assert (first, second, code) == (False, True, None) and G.same(managed, more) and len(whole) == 3
    assert reconciled(managed=more, whole=[*both, more[-1]])[2:] == (True, True, None)
    assert reconciled(managed=more, whole=both[:1])[4] == "managed-graph-inconsistent"
    assert reconciled(whole=both[1:])[4] == "managed-graph-not-additive"
    assert reconciled(managed=[entry({"@id": "https://e/p", "@type": "WebPage", "name": "Not P"})])[4] == "managed-graph-invalid"


def test_pages_are_reconciled(spark):
    both = envelope.combine(OWN, OURS)
    person = entry({"@id": "https://e/q", "@type": "Person", "name": "Q"})
    cases = {"/same": {}, "/managed": {"managed": [*OURS, person]}, "/whole": {"whole": [*both, person]}, "/less": {"whole": both[1:]}, "/authored": {"authored": []}, "/bad": {"managed": "no json"}, "/bare": {"managed": [person]}, "/none": {"managed": [], "whole": []}}

    def rows(path, views):
        return [("e", path, v, k, e if isinstance(e, str) else json.dumps(e["entity"]), [], json.dumps(e["provenance"]) if isinstance(e, dict) else None) for v, es in views.items() for k, e in enumerate([es] if isinstance(es, str) else es)]

    first = {"authored": OWN, "managed": OURS, "whole": both}
    schema = "site string, pathname string, view string, ord int, entity string, roles array<string>, provenance string"
    base = spark.createDataFrame([r for p in cases for r in rows(p, first)], schema).repartition(3)
    edited = spark.createDataFrame([r for p, c in cases.items() for r in rows(p, first | c)], schema).repartition(2)
    pages = spark.createDataFrame([("e", p, None if p in ("/bare", "/none") else "https://e" + p) for p in cases], "site string, pathname string, canonical_url string")
    changed = {r.pathname: (r.authored, r.managed, r.whole) for r in envelopes.changed_views(base, edited).collect()}
    assert changed == {"/managed": (False, True, False), "/whole": (False, False, True), "/less": (False, False, True), "/authored": (True, False, False), "/bad": (False, True, False), "/bare": (False, True, False), "/none": (False, True, True)}
    got = envelopes.reconcile_pages(base, edited, pages).collect()
    count = lambda path, kind, view=None: sum(r.pathname == path and r.kind == kind and view in (None, r.view) for r in got)
    assert {r.pathname: r.code for r in got if r.kind == "finding"} == {"/less": "managed-graph-not-additive", "/authored": "managed-graph-authored-changed", "/bad": "managed-graph-invalid", "/bare": "managed-graph-canonical-missing"}
    assert [count(p, "entry", "managed") for p in cases] == [1, 2, 2, 1, 1, 1, 1, 0]
    assert [count(p, "entry", "whole") for p in cases] == [2, 3, 3, 2, 2, 2, 2, 0]
    assert {(r.pathname, r.view, r.code) for r in got if r.kind == "patch"} == {("/managed", "add", "https://e/q"), ("/whole", "add", "https://e/q"), ("/none", "remove", "https://e/o")}


def test_references_across_pages(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        value = {"@type": "Thing", "@id": f"https://e/{rng.randrange(12)}", "name": f"n{rng.randrange(2)}", "part": [{"@id": f"https://e/{rng.randrange(30)}"}, {"@id": "https://far/x"}], "deep": {"@type": "Thing", "@id": f"https://e/in{rng.randrange(9)}", "k": k}}
        rows.append(("e", f"/p{k % 7}", k, json.dumps(value)))
    rows.append(("e", "/x", 99, '{"@type": "Thing", "part": {"@id": "https://e/in3"}, "to": {"@id": "https://e/none"}}'))
    table = spark.createDataFrame(rows, "site string, pathname string, ord int, entity string").repartition(4)
    sites = spark.createDataFrame([("e", "https://e/")], "site string, site_url string")
    found = envelopes.site_findings(table, sites).collect()
    lost = {r.entity_id for r in found if r.code == "schema.unresolved-reference"}
    inputs = [{"entity": json.loads(r[3])} for r in rows]
    merged, want = G.validate(inputs, None, "https://e/", set(), True)
    assert lost == {f["entity_id"] for f in want if f["code"] == "schema.unresolved-reference"} and "https://e/none" in lost
    clashes = {r.entity_id for r in found if r.code == "schema.scalar-conflict"}
    assert clashes == {f["entity_id"] for f in want if f["code"] == "schema.scalar-conflict"} and clashes
    bad = envelopes.site_findings(table.limit(0).unionByName(spark.createDataFrame([("e", "/", 0, "{"), ("e", "/", 1, None)], table.schema)), sites).collect()
    assert [r.code for r in bad] == ["schema.invalid-graph"] * 2


def test_entity_order(spark):
    values = ['{"@type":"B","name":"b"}', '{"@id":"b","@type":"A"}', '{"@id":"a","@type":["Z","A"]}', '{"@id":"a","@type":"Y"}', '{"@type":"A"}']
    df = spark.createDataFrame([(v,) for v in values], "entity string")
    assert [values.index(r.entity) for r in df.orderBy(*envelopes.entity_order(df.entity)).collect()] == [3, 2, 1, 4, 0]
