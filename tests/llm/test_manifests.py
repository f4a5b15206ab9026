"""Merkle manifest and divergence audit against brute force, with odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sitegrain.llm import divergence, merkle
from sitegrain.llm.common import staged

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(top, path of each node): hashes of the siblings left and right, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // 16 * 16 : place // 16 * 16 + 16]
            paths[k].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
            at[k] = place // 16
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, upper = tree([built[g][0] for g in names])
    out = []
    for g, above in zip(names, upper, strict=True):
        top, paths = built[g]
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths, strict=True):
            path, acc = path + above, own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                acc = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                acc = sha(left + acc + right)
            out.append((r[0], own, top, root, sha("".join(a + b for a, b in path)), acc, acc == root))
    return collections.Counter(out)


def documents(rng):
    row = lambda i, s: (i, s, rng.choice(["en", None]), rng.choice([None, 3]), rng.choice([None, "", "Äb C", "text " * rng.randint(1, 9) + str(i)]))
    rows = [row(i, f"s{i % 3 if i % 2 else 0}") for i in range(700)]
    rows += [row(i, None) for i in (5, -7, 1 << 62, -(1 << 63), None, None)] + [row(9, ""), row(3, "lone"), row(12, "é"), row(12, "é"), row(13, "z")]
    return rows + rows[:20] + [row(4, f"many{i}") for i in range(40)]


@pytest.mark.parametrize("bucket", [1024, 8])
def test_manifest(spark, monkeypatch, bucket):
    monkeypatch.setattr(merkle, "BUCKET", bucket)
    rows = documents(random.Random(3))
    rows += [rows[0]] * 50
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", g int, r int").repartition(5)
    got = merkle.digest(df).collect()
    assert collections.Counter(map(tuple, got)) == brute(rows)
    assert any(not r.verified for r in got)


def test_manifest_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.digest(empty).count() == 0
    one = merkle.digest(spark.createDataFrame([(1, "a", "en", 2, "x" * 3_000_000)], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")


def test_ranks_of_strings(spark):
    rng = random.Random(8)
    ids = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(400)]
    df = spark.createDataFrame([(i, "g") for i in ids], "i string, g string")
    rows = staged(df.select("g", merkle._digits(df, "i").alias("key"), "i"), "test")
    out, _ = merkle.ranked(rows)
    assert [r.i for r in out.orderBy("r").collect()] == sorted(ids, key=str.encode)
    assert sorted(r.r for r in out.collect()) == list(range(400))


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, least):
    found, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        ts = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        found[lang, source].update(ts)
        docs[lang].update(set(ts))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p(counts):
            whole = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // whole for t in kept}

        own = {s: p(found[lang, s]) for s in sources}
        common = p(sum((found[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            pairs = [(-sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(common[t] - own[s][t], t) for t in kept if found[lang, s][t] and own[s][t] > common[t]]
            for part, ranks in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])):
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(ranks, 1)}
    return out


@pytest.mark.parametrize(("tile", "chunk"), [(8, 1 << 15), (2, 16)])
def test_divergence(spark, tile, chunk):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    rows = [(" ".join(rng.choice(words) for _ in range(40)) + " Ab1Ab", rng.choice(["en", "de"]), f"s{rng.randrange(9)}") for _ in range(150)]
    rows += [(None, "en", "silent"), ("", None, None), ("x", "fr", "a"), ("y", "fr", "b"), ("ab " * 100_000, "en", None), ("ab", "en", "")] + rows[:1] * 40
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "text string, lang string, source string, term int, slot string").repartition(5)
    got = {tuple(r) for r in divergence.audit(df, least=20, tile=tile, chunk=chunk).collect()}
    assert got == brute_audit(rows, 20)


def test_divergence_without_rows(spark):
    assert divergence.digest(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    for _ in range(200):
        total = rng.randrange(1, 9 * 10**15)
        counts = np.array([rng.randrange(0, max(1, total - 5)) for _ in range(5)], np.int64)
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in counts]


def test_terms():
    for text in ("Ab1cé-ÉÀ z y_[\x7f", "İI ｆ９", ""):
        assert [t.decode() for t in divergence.terms(text.encode())] == TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
