"""Edits of several producers against carrying them out one after another."""

from __future__ import annotations

import random

from sitegrain.functions import edits


def put(text, changes):
    for start, stop, new in sorted(changes, key=lambda e: (e[0], e[1]), reverse=True):
        text = text[:start] + new + text[stop:]
    return text


def some(rng, size, letter):
    out, at = [], 0
    for _ in range(rng.randint(0, 4)):
        start = rng.randint(at, max(at, size))
        stop = rng.randint(start, max(start, min(size, start + 4)))
        out.append((start, stop, letter * rng.randint(0, 3)))
        at = stop + 1
    return [e for e in out if e[1] <= size]


def cases(rng, n):
    for _ in range(n):
        first = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))
        text, turns = first, []
        for k in range(rng.randint(0, 4)):
            changes = some(rng, len(text), "XYZW"[k])
            turns.append(changes)
            text = put(text, changes)
        yield first, turns, text


def test_composed_edits_equal_successive_ones():
    for first, turns, text in cases(random.Random(6), 4000):
        base = edits.compose(turns)
        assert put(first, [(a, min(b, len(first)), p) for a, b, p in base]) == text
        assert all(x[1] <= y[0] for x, y in zip(base, base[1:], strict=False))


def test_redactions_come_last_and_take_insertions_along():
    rng = random.Random(9)
    for _ in range(3000):
        first = "".join(chr(0x100 + k) for k in range(rng.randint(0, 25)))  # each code point once
        text, turns = first, []
        for k in range(rng.randint(0, 3)):
            changes = some(rng, len(text), "XYZ"[k])
            turns.append(changes)
            text = put(text, changes)
        gone = [(a, b, "") for a, b, _ in some(rng, len(first), "R")]
        out = put(first, [(a, min(b, len(first)), p) for a, b, p in edits.compose(turns, gone)])
        hidden = {c for a, b, _ in gone for c in first[a:b]}
        assert not hidden & set(out)
        assert [c for c in out if ord(c) >= 0x100] == [c for c in text if ord(c) >= 0x100 and c not in hidden]


def test_a_redaction_can_leave_a_mark():
    assert put("abcdef", [(a, min(b, 6), p) for a, b, p in edits.compose([], [(2, 4, "#")])]) == "ab#ef"
    out = edits.compose([[(3, 3, "SECRET")], [(0, 1, "Z")]], [(2, 4, "#")])
    assert put("abcdef", [(a, min(b, 6), p) for a, b, p in out]) == "Zb#ef"


def test_staged_and_spliced(spark):
    rng = random.Random(12)
    rows, pages, want = [], [], {}
    for k, (first, turns, text) in enumerate(cases(rng, 300)):
        rows += [(k, turn, False, a, b, p) for turn, changes in enumerate(turns) for a, b, p in changes]
        pages.append((k, first))
        want[k] = text
    rows += [(1000, 0, False, 2, 5, "x"), (1000, 0, False, 4, 6, "y"), (1000, 1, True, 0, 2, None), (1000, 2, True, 1, 3, "")]
    pages.append((1000, "secret text"))
    table = spark.createDataFrame(rows, "page int, turn int, redaction boolean, start int, stop int, put string").repartition(4)
    both = spark.createDataFrame(pages, "page int, body string").join(edits.staged(table, ["page"]), "page", "left")
    got = {r.page: r for r in both.select("page", "fault", edits.splice(both.body, both.edits).alias("body")).collect()}
    assert got[1000].body == "ret text" and got[1000].fault == "producer 0: overlap at 4"
    assert {k: r.body for k, r in got.items() if k < 1000} == want
    alone = edits.staged(table, ["page"], failed=True).collect()
    assert [r.page for r in alone] == [1000] and not alone[0].fault
