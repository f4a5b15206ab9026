"""Operators against brute force, on small fixtures with nulls, ties and odd texts."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sitegrain.llm import decontamination, jaccard, mixing, packing, quality, sharding, substrings, suffixes, tokens, urls
from sitegrain.llm.kernels import _BYTE64, mix, run_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120, 300]))) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(90))
    out = list(texts)
    for k in range(0, 60, 4):  # near copies, shared passages, exact copies
        words = texts[k].split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
        out.append(f"{texts[k + 1]}\n{passage} {texts[k + 2]}")
        out.append(texts[k + 3])
    out += [None, "", " \t\n", "one", "a b", "A B", "x y " * 60, "a" * 900, "é" * 401, "line one\n" * 12, "don't  we'll\n\n 'tis  12ab ½", "日本 <|endoftext|> x", "hash### tag$$$ " * 30, "q\x0bw\x0ce\rr"]
    source = lambda i: None if i % 7 == 0 else f"src{i % 3 if i % 2 else 0}"
    return [(i, t, source(i)) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def by_id(df):
    got = df.collect()
    out = {r.doc_id: r for r in got}
    assert len(out) == len(got)
    return out


def test_quality_counts(docs, rows, nothing):
    got = by_id(quality.digest(docs))
    for i, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        n = len(words)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(words[k : k + 5]) for k in range(n - 4))
        covered = {j for k in range(n - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        want = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 10 or 100 * len(covered) > 20 * n)
        assert not (r.base_failed and r.kept)
    assert quality.digest(nothing).count() == 0


def test_quality_keeps_columns(docs):
    clash = docs.selectExpr("*", "1 AS quality", "2 AS n_words")
    kept = quality.keep_good(clash)
    assert kept.columns == clash.columns
    assert 0 < kept.count() < docs.count()


def _voted(rng, n, right_on_bad, objects_to_good):
    """(votes, whether good) of ``n`` documents, a tenth of them bad, by rules that err on their own."""
    out = []
    for _ in range(n):
        good = rng.random() >= 0.1
        rates = objects_to_good if good else right_on_bad
        out.append((tuple(0 if rng.random() < 0.1 else -1 if rng.random() < p else 1 for p in rates), good))
    return out


def test_label_model_outvotes_a_rule_that_objects_to_good_documents():
    rng = random.Random(8)
    # Three rules that see most faults, and one that objects to every fifth good document.
    rows = _voted(rng, 20_000, (0.8, 0.8, 0.7, 0.3), (0.01, 0.02, 0.01, 0.2))
    model = quality.fit(sorted(collections.Counter(v for v, _ in rows).items()), 4)
    assert model.posterior((1, 1, 1, -1)) > 0.9  # one objection is outvoted
    assert model.posterior((-1, -1, 1, 1)) < 0.1
    assert abs(model.prior - 0.9) < 0.03 and abs(model.good[3] - 0.2) < 0.03 and abs(model.bad[0] - 0.8) < 0.08
    fresh = _voted(rng, 5_000, (0.8, 0.8, 0.7, 0.3), (0.01, 0.02, 0.01, 0.2))
    right = sum((model.posterior(v) >= 0.5) == good for v, good in fresh) / len(fresh)
    all_pass = sum((min(v) >= 0) == good for v, good in fresh) / len(fresh)
    assert right > 0.95 > all_pass
    # A rule worse than chance says nothing; without rows nothing is known.
    assert quality.fit([((1, -1), 90), ((-1, 1), 10), ((1, 1), 10)], 2).posterior((0, 0)) > 0
    assert quality.fit([], 2).posterior((-1, -1)) == 0.5


def test_shards_are_gapless_even_and_repeatable(docs, rows, nothing):
    got = by_id(sharding.digest(docs, 7))
    again = by_id(sharding.digest(docs.repartition(5), 7))
    assert got == again
    slots = collections.defaultdict(list)
    for i, text, _ in rows:
        r = got[i]
        assert r.size == 16 + len((text or "").encode()) and r.text_crc32 == zlib.crc32((text or "").encode())
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(7)]
    assert max(counts) - min(counts) <= 1
    assert [got[i].shard for i in sorted(got)] != sorted(got[i].shard for i in got)
    assert sharding.digest(nothing, 7).count() == 0


def test_shuffle_has_many_buckets_and_repeated_rows(spark):
    df = spark.range(500).selectExpr("id % 100 AS doc_id", "'x' AS shard")
    out = sharding.shuffle_to_shards(df, 3, ["doc_id"], bucket_rows=20).collect()
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s, n in ((0, 167), (1, 167), (2, 166)) for k in range(n)]
    assert collections.Counter(r.doc_id for r in out) == {k: 5 for k in range(100)}


def test_word_dedup(docs, rows, nothing):
    got = by_id(substrings.digest(docs))
    split = [(i, WORD.findall(t or "")) for i, t, _ in rows]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in split for k in range(len(w) - 34))
    for i, w in split:
        drop = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in drop)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(drop), hashlib.sha256(kept.encode()).hexdigest())
    assert any(r.n_removed for r in got.values())
    assert substrings.digest(nothing).count() == 0


@pytest.mark.parametrize("group", [128, 1])
def test_byte_dedup(docs, rows, nothing, group, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    got = by_id(suffixes.digest(docs))
    split = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = collections.Counter(b[k : k + 400] for _, b in split for k in range(len(b) - 399))
    for i, b in split:
        drop = np.zeros(len(b), np.int8)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                drop[k : k + 400] = 1
        kept = bytes(np.frombuffer(b, np.uint8)[drop == 0])
        runs = int((np.diff(np.concatenate([[0], drop])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(drop.sum()), runs, hashlib.sha256(kept).hexdigest())
    if group == 1:
        assert suffixes.digest(nothing).count() == 0


def test_cut_keeps_clashing_columns(docs):
    out = substrings.cut(docs.selectExpr("*", "1 AS spans", "2 AS kept", "3 AS k1", "4 AS row", "5 AS asks"))
    assert {"doc_id", "text", "k1", "row", "asks", "n_words", "n_removed", "kept"} <= set(out.columns)
    assert out.filter("k1 = 3 AND row = 4 AND asks = 5").count() == docs.count()


def test_bwt_expansion_on_random_texts():
    rng = random.Random(2)
    for _ in range(40):
        run = rng.choice([2, 4, 7])
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        m = len(texts)
        symbols = np.array([s for k, t in enumerate(texts) for s in [*(b + m for b in t), k]], np.int32)
        assert suffixes.suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        seen = collections.Counter(t[k : k + run] for t in texts for k in range(len(t) - run + 1))
        want = [k + run <= len(t) and seen[t[k : k + run]] > 1 for t in texts for k in range(len(t) + 1)]
        assert suffixes.repeated_starts(symbols, m, run).tolist() == want


def _components(rows, width, percent):
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall(lowered(t or ""))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("tile", [256, 2])
def test_jaccard(docs, rows, nothing, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "SCREENED", 16 if tile == 256 else 2)
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(jaccard.digest(docs)).items()}
    assert got == _components(rows, 3, 90)
    if tile == 2:
        assert jaccard.digest(nothing).count() == 0
        kept = {r.doc_id for r in jaccard.one_of_each(docs).collect()}
        want = _components(rows, 5, 80)
        assert kept == {i for i, (n, c) in want.items() if c == i}


def test_signatures_of_linked_sets_meet():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.choice([1, 2, 9, 10, 19, 40, 150, 900])
        x = {rng.getrandbits(63) for _ in range(n)}
        y = set(x)
        for _ in range(rng.randint(0, n // 9)):
            y.discard(next(iter(y)))
        y |= {rng.getrandbits(63) for _ in range(rng.randint(0, n // 12))}
        for t in (0.9, 0.8):
            if y and len(x & y) >= t * len(x | y):
                a, b = (set(jaccard.signatures(np.array(sorted(s), np.uint64), t).tolist()) for s in (x, y))
                assert a & b


def test_decontamination(spark, docs, rows):
    rng = random.Random(9)
    words = [WORD.findall(t) for _, t, _ in rows if t and len(WORD.findall(t)) > 60]
    items = [(k, " ".join(w[5 : 5 + rng.choice([7, 20, 45])]).upper() if k % 2 else " ".join(w[5:40])) for k, w in enumerate(words)]
    items += [(900, None), (901, ""), (902, "never seen words in any of these texts at all"), (903, "日本")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.shared for r in decontamination.digest(docs, bench).collect()}
    want = {}
    for k, text in items:
        w = WORD.findall(lowered(text or ""))
        width = min(5, len(w))
        own = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if w else set()
        step = decontamination._limit(len(own))
        for i, t, _ in rows:
            v = WORD.findall(lowered(t or ""))
            runs = [tuple(v[j : j + width]) for j in range(len(v) - width + 1)] if w else []
            best = max((len(own & set(runs[j : j + 2 * step])) for j in range(0, len(runs), step)), default=0)
            if best and best >= 0.8 * len(own):
                want[i, k] = best
    assert got == want and want
    left = decontamination.remove_contaminated(docs.selectExpr("*", "1 AS matches", "1 AS _matches"), bench)
    assert {r.doc_id for r in left.collect()} == {i for i, _, _ in rows} - {i for i, _ in want}


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(k, r.text) for k, r in enumerate(docs.filter("length(text) > 200").limit(9).collect())], "item_id long, text string")
    want = sorted(map(tuple, decontamination.digest(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 1500)
    assert sorted(map(tuple, decontamination.digest(docs, bench).collect())) == want


def test_mix_reaches_targets(docs, rows, nothing):
    got = by_id(mixing.digest(docs))
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    sums, taken = collections.Counter(), collections.Counter()
    for i, _, s in rows:
        sums[s] += size[i]
        taken[s] += got[i].taken
        assert got[i].size == size[i] and got[i].taken in (0, size[i], 2 * size[i])
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    # The targets by bisection: a level by which weights are multiplied, stopped at twice the size.
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    low, high, total = 0.0, 4.0 * sum(sums.values()), 1.5 * sum(sums.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sums[s], level * weight[s]) for s in order) < total else (low, level)
    want = {s: min(2 * sums[s], high * weight[s]) for s in order}
    for i, _, s in rows:
        assert got[i].source_size == sums[s] and abs(got[i].target - want[s]) < 1e-3
    for s in order:  # no document that may be taken once more fits into what is left
        left = want[s] - taken[s]
        assert left > -1 and not any(0 < size[i] < left and got[i].taken < 2 * size[i] - size[i] * (want[s] < sums[s]) for i, _, x in rows if x == s)
    assert by_id(mixing.digest(docs.repartition(7))) == got
    assert mixing.digest(nothing).count() == 0


def test_flow_prefers_first_passes():
    flow = mixing.min_cost_flow({"a": 100, "b": 100, "ab": 100}, {"a": [0], "b": [1], "ab": [0, 1]}, [150, 180], 2)
    assert sum(f[0] for f in flow.values()) == 300 and sum(map(sum, flow.values())) == 330
    assert mixing.water_fill([10, 100], [5, 2], 60, 2) == [20.0, 40.0]


def test_mix_of_overlapping_sources(spark):
    df = spark.createDataFrame([(k, 10, [["a"], ["b"], ["a", "b"]][k % 3]) for k in range(300)], "doc_id long, n long, source array<string>")
    out = mixing.mix(df, "n").collect()
    assert abs(sum(r.taken for r in out) - 4500) < 60 and max(r.copies for r in out) <= 2


def test_token_files(docs, rows, nothing):
    encode = tokens.encoder(tokens.default_vocabulary()).whole.encode
    got, start = by_id(packing.digest(docs)), 0
    for i, t, _ in rows:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert packing.digest(nothing).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1024, 3000):
        for top in (1, 300, 2**16, 2**32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[::97] = 2**32 - 1
            data = packing.encode_blocks(ids)
            assert (packing.decode_blocks(data, n) == ids).all()
            assert (packing.decode_blocks(data, n, n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_length_histogram(docs, rows, nothing):
    encode = tokens.encoder(tokens.default_vocabulary()).whole.encode
    lengths = [len(encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    table = tokens.length_histogram(docs, block=16).collect()
    assert {r.length: r.n_docs for r in table} == collections.Counter(lengths)
    for r in table:
        assert r.docs_from == sum(n >= r.length for n in lengths) and r.tokens_from == sum(n for n in lengths if n >= r.length)
        assert r.total_tokens == sum(lengths) and r.truncated_tokens == sum(min(n, r.length) for n in lengths)
        assert abs(r.quantile - sum(n <= r.length for n in lengths) / len(lengths)) < 1e-9
    for limit in (0, 7, 100, 10**6):
        assert tokens.truncated_total(tokens.length_histogram(docs), limit).first()[0] == sum(min(n, limit) for n in lengths)
    assert tokens.length_histogram(nothing).count() == 0


def test_url_rules(spark):
    cases = [
        ("HTTP://A.Com", "a.com", "", None), ("https://www.example.com/en/x?y", "www.example.com", "/en/x", "www.example.com/en/"), ("https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/"),
        ("https://x.example.com/en", "x.example.com", "/en", "com/"), ("ftp://E.net/fr/1#a", "e.net", "/fr/1", "net/fr/"), ("no url", "", "", None), (None, "", "", None), ("https://h?x/y", "h", "", None),
        ("a://b://c/d", "b:", "//c/d", None), ("https://notexample.com/en/", "notexample.com", "/en/", "com/"), ("", "", "", None),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)] + [(99, cases[1][0])], "page_id long, url string")
    got = {r.page_id: r for r in urls.digest(df).collect()}
    verdicts = {f"{h}{p}": v for v, h, p in urls.RULES}
    for k, (_, host, path, rule) in enumerate(cases):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdicts[rule] if rule else got[k].verdict in ("allow", "block")
    assert got[99].verdict == "allow" and urls.digest(df.limit(0)).count() == 0


def test_url_model_reads_every_gram(spark):
    host, path = "^ab.example$", "/x/00"
    rows = spark.createDataFrame([("https://ab.example/x/19",)], "url string")
    [row] = rows.select(urls.buckets(*urls.host_and_path(rows["url"])).alias("b")).collect()
    assert len(row.b) == sum(max(len(t) - n + 1, 0) for t in (host, path) for n in urls.GRAMS)
    want = spark.sql("SELECT " + ", ".join(f"pmod(xxhash64({salt}, '{t[k : k + n]}'), {urls.BUCKETS})" for salt, t in ((1, host), (2, path)) for n in urls.GRAMS for k in range(len(t) - n + 1))).first()
    assert row.b == list(want)


def test_url_model_on_held_out_hosts(spark):
    bad, all_bad, good, all_good = urls.held_out(spark)
    assert all_bad + all_good == len(urls.labelled_urls())
    assert bad >= 0.85 * all_bad and good >= 0.95 * all_good


def test_odd_texts_do_not_stop_the_encoder():
    import pyarrow as pa

    encode = tokens.encoder(tokens.default_vocabulary()).whole.encode
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab 1'\n\tsé½!-\u00a0\u2003日<|") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    want = [encode(t, add_special_tokens=False).ids for t in texts]
    got, at = [], 0
    for _, ids, counts in tokens.encode_rows(pa.array(texts), tokens.default_vocabulary()):
        cuts = np.cumsum([0, *counts])
        got += [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert got == want


def test_shards_move_texts_and_read_them_back(docs, rows, monkeypatch):
    """Size and CRC are of the texts that the written buckets hold."""
    from pyspark.sql import functions as F

    kept = []

    def spoiled(df, name):
        kept.append(staged(df, name))
        item = lambda x: x.withField("row", x["row"].withField("text", F.concat(x["row"]["text"], F.lit("!"))))
        return kept[-1].withColumn("items", F.transform("items", item))

    staged = sharding.staged
    monkeypatch.setattr(sharding, "staged", spoiled)
    got = by_id(sharding.digest(docs, 7))
    held = kept[0].select(F.explode("items").alias("i")).select("i.row.doc_id", "i.row.text").collect()
    assert sorted((i, t) for i, t in held if t is not None) == sorted((i, t) for i, t, _ in rows if t is not None)
    for i, text, _ in rows:
        came = "" if text is None else text + "!"
        assert (got[i].size, got[i].text_crc32) == (16 + len(came.encode()), zlib.crc32(came.encode()))


def test_written_shards_hold_the_texts_in_slot_order(spark, docs, rows, tmp_path):
    sharded = sharding.shuffle_to_shards(docs, 3, ["doc_id"])
    sharding.write_shards(sharded, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text", "source").collect()
    key = lambda r: (r[0], r[1] or "", r[2] or "")
    assert sorted(map(tuple, back), key=key) == sorted(rows, key=key)
    for k in range(3):
        slots = [r.slot for r in spark.read.parquet(str(tmp_path / "out" / f"shard={k}")).collect()]
        assert slots == list(range(len(slots)))


def test_items_of_few_shingles_are_always_found(spark):
    rng = random.Random(3)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(5 + k % 3))) for k in range(300)]
    fill = lambda: " ".join(str(rng.random()) for _ in range(40))
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = spark.createDataFrame([(k, f"{fill()} {t} {fill()}") for k, t in items], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.digest(texts, bench).collect()}
    assert got == {(k, k) for k, _ in items}


def test_jaccard_links_are_all_returned(spark):
    rng = random.Random(8)
    texts = [" ".join(f"g{g}w{j}" for j in range(200)) for g in range(3)]
    made = []
    for g, text in enumerate(texts):  # near copies at one place each, so that all of a group link
        for k in range(6):
            words = text.split()
            words[10 * k] = f"other{g}x{k}"
            made += [" ".join(words)] * (1 + k % 2)
    made += [" ".join(str(rng.random()) for _ in range(50)) for _ in range(5)] + ["", None, "one", "one"]
    rows = list(enumerate(made))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {}
    for i, t in rows:
        w = WORD.findall(lowered(t or ""))
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()
    first, copies = {}, collections.Counter(sets.values())
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = set()
    for x, a in first.items():
        for y, b in first.items():
            if x and (a < b or (a == b and copies[x] > 1)) and 100 * len(x & y) >= 90 * len(x | y):
                want.add((a, b, len(x & y), len(x), len(y), copies[x], copies[y]))
    assert sum(a != b for a, b, *_ in want) == 45
    assert sorted(map(tuple, jaccard.links(df).collect())) == sorted(want)


def test_passages_below_the_removed_length_are_reported(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)[:350]
    rows = [(k, f"{text(150)} {passage} {text(150)}" if k < 12 else text(360)) for k in range(24)]
    # Two that share 300 and 320 bytes of a text of theirs with one each: no run of 400 repeats.
    a, b, c = text(25)[:140], text(35)[:200], text(25)[:140]
    rows += [(24, f"{text(90)} {a}{b}{c} {text(90)}"), (25, f"{text(90)} {a}{b} {text(90)}"), (26, f"{text(90)} {b}{c} {text(90)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    for group in (4096, 1):
        monkeypatch.setattr(suffixes, "GROUP", group)
        got = by_id(suffixes.digest(df))
        seen.append(got)
        assert all(r.n_removed == 0 for r in got.values())
        assert all(r.longest_shared <= 399 for r in got.values())
        assert sum(got[k].longest_shared >= 250 for k in range(12)) >= 10
        assert all(got[k].longest_shared == 0 for k in range(12, 24))
    assert seen[0] == seen[1]


def test_frequent_contexts_meet_their_neighbours_alone(spark, monkeypatch):
    """What sides share equals brute force over all pairs, by two rows a context."""
    rng = random.Random(9)
    anchor = bytes(rng.randrange(97, 123) for _ in range(64))
    (h,) = mix(run_hash(_BYTE64[0][np.frombuffer(anchor, np.uint8)], 64)).view(np.int64).tolist()
    rows = []
    for k in range(90):
        left, right = (bytearray(b"xyz" * 112) for _ in range(2))
        for part in (left, right):
            for at in rng.sample(range(336), k % 3):
                part[at] = 48 + rng.randrange(10)
        cut = rng.choice([0, 0, 100])
        rows.append((h, k // 2, 7, 1000 * (k % 2), True, bytes(left[cut:] + anchor + right)))
    table = spark.createDataFrame([*rows, *rows[:20]], suffixes._CONTEXT).repartition(5)
    sizes, before = [], suffixes.staged

    def staged(df, name):
        out = before(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(suffixes, "staged", staged)
    got = {(r.k1, r.lo, r.hi) for r in suffixes._reached(table, suffixes.UNIT).collect()}
    want = set()
    for _, k1, _, lo, _, body in rows:
        at = body.index(anchor)
        n = [0, 0]
        for _, j1, _, jo, _, other in rows:
            if (j1, jo) != (k1, lo):
                b = other.index(anchor)
                for side, (x, y) in enumerate(((body[:at][::-1], other[:b][::-1]), (body[at + 64 :], other[b + 64 :]))):
                    n[side] = max(n[side], len(os.path.commonprefix([x, y])) // 16 * 16)
        if n[0] + n[1] + 64 >= suffixes.PASSAGE:
            want.add((k1, lo + at - n[0], min(lo + at + 64 + n[1], lo + at - n[0] + 399)))
    assert got == want and len(want) > 30
    assert max(sizes) <= 2 * len(rows)


@pytest.mark.parametrize("module", [suffixes, substrings])
def test_very_long_texts_are_cut_whole(spark, module):
    """A text of 5 MB, past the span that is looked at at a time, with a passage near either end."""
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 40, 640_000).astype("U13")
    passage = " ".join(words[1000:1200])
    long = " ".join([*words[:600_000], passage, *words[600_000:]])
    df = spark.createDataFrame([(1, long), (2, "x " + passage + " y")], "doc_id long, text string")
    got = by_id(module.digest(df))
    whole = len(passage.encode()) if module is suffixes else 200
    assert whole <= got[2].n_removed <= whole + 3 and 2 * whole <= got[1].n_removed <= 2 * whole + 6


@pytest.mark.parametrize("words", [1, 2, 3, 5, 6, 7, 9, 12, 20, 40, 90])
def test_recall_of_items_of_every_length(spark, words):
    rng = random.Random(words)
    text = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    items = [(k, text(words)) for k in range(200)]
    index = decontamination.build_index(items)
    planted = [f"{text(rng.randrange(1, 200))} {t} {text(rng.randrange(1, 200))}" for _, t in items]
    found = decontamination._matches(index, pa.array(planted, pa.large_string())).to_pylist()
    assert sum(any(m["item_id"] == k for m in ms) for k, ms in enumerate(found)) >= 0.99 * len(items)


def test_shards_split_repeated_rows_and_keep_clashing_columns(spark, monkeypatch):
    df = spark.range(3000).selectExpr("IF(id < 2000, 0, id) AS doc_id", "'t' AS text", "1 AS place", "2 AS item", "3 AS copy", "4 AS h1", "5 AS bucket")
    out = sharding.shuffle_to_shards(df, 7, ["doc_id"], bucket_rows=50).collect()
    monkeypatch.setattr(sharding, "COPIES", 64)  # made again in 32 places, to the same end
    assert sorted(sharding.shuffle_to_shards(df, 7, ["doc_id"], bucket_rows=50).collect()) == sorted(out)
    assert len(out) == 3000 and {(r.place, r.item, r.copy, r.h1, r.bucket) for r in out} == {(1, 2, 3, 4, 5)}
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(7) for k in range(429 if s < 4 else 428)]
    spread = collections.Counter(r.shard for r in out if r.doc_id == 0)
    assert max(spread.values()) - min(spread.values()) < 100


def test_operators_keep_clashing_columns(docs):
    odd = docs.selectExpr("*", "1 AS _body", "2 AS row", "3 AS pattern", "4 AS h", "5 AS size", "6 AS f", "7 AS k1")
    n = docs.count()
    for out in (suffixes.cut(odd), substrings.cut(odd), quality.judge(odd), mixing.mixed_documents(odd), jaccard.one_of_each(odd)):
        held = out.filter("_body = 1 AND row = 2 AND pattern = 3 AND h = 4 AND size = 5 AND f = 6 AND k1 = 7").count()
        assert held == out.count() > n / 3
