"""Artifact commit: decisions, transactions that fail half-way, runs after runs."""

from __future__ import annotations

import hashlib
import json
import os
import random

import pytest
from pyarrow import fs

from sitegrain.operators import ownership, publishing
from sitegrain.sources import sinks, transactions

CLAIM = "site string, claim_id int, owner_name string, served_key string, dest string, grp string, replace boolean, body string"


def tree(root):
    out = {}
    for folder, _, names in os.walk(root):
        for n in names:
            path = os.path.relpath(os.path.join(folder, n), root)
            if not path.startswith("."):
                out[path] = open(os.path.join(folder, n), "rb").read()
    return out


def hidden(root):
    return [n for n in os.listdir(root) if n.startswith(".transaction")]


def claims(spark, rows):
    full = [("s", k, r.get("owner", "core"), r["dest"], r["dest"], r.get("grp"), r.get("replace", False), r.get("body", "b")) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, CLAIM).repartition(3)


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path / "out")


def ops(spark, rows):
    return spark.createDataFrame(rows, "kind string, path string, body string").repartition(3)


def test_transaction_writes_and_deletes(spark, root):
    assert transactions.commit(ops(spark, [("write", "a/b.md", "one"), ("write", "c", "two"), ("write", "e", None)]), root) == 3
    assert tree(root) == {"a/b.md": b"one", "c": b"two", "e": b""}
    transactions.commit(ops(spark, [("write", "a/b.md", "new"), ("delete", "c", None), ("delete", "never", None)]), root)
    assert tree(root) == {"a/b.md": b"new", "e": b""} and not hidden(root)


@pytest.mark.parametrize("when", [0, 3, 11])
def test_a_failure_leaves_the_old_tree(spark, root, when):
    transactions.commit(ops(spark, [("write", f"d{k}/f", f"old {k}") for k in range(9)]), root)
    before = tree(root)

    def breaks(path):
        if path == f"d{when}/f":
            raise OSError("disk full")

    change = [("write" if k % 3 else "delete", f"d{k}/f", f"new {k}") for k in range(12)]
    with pytest.raises(transactions.TransactionError, match="disk full"):
        transactions.commit(ops(spark, change), root, before_apply=breaks)
    assert tree(root) == before and not hidden(root)

    def last():
        raise KeyError("manifest")

    with pytest.raises(KeyError):
        transactions.commit(ops(spark, change), root, then=last)
    assert tree(root) == before and not hidden(root)


def test_refused_operations(spark, root):
    for rows in ([("write", "a", "1"), ("write", "a", "2")], [("write", "a", "1"), ("write", "a/b", "2")]):
        with pytest.raises(transactions.TransactionError, match="collide"):
            transactions.commit(ops(spark, rows), root)
    for path in ("../x", "/x", "a//b", "a/./b", "a\\b", "", ".transaction-1/x"):
        with pytest.raises(Exception, match="unsafe path|reserved name"):
            transactions.commit(ops(spark, [("write", path, "1")]), root)
    with pytest.raises(ValueError):
        transactions.commit(ops(spark, [("write", "a", "1")]), root, name="../x")
    os.makedirs(f"{root}/folder/in")
    with pytest.raises(Exception, match="is a folder"):
        transactions.commit(ops(spark, [("write", "x", "1"), ("write", "folder", "1")]), root)
    os.makedirs(f"{root}-other")
    os.symlink(f"{root}-other", f"{root}/link")
    with pytest.raises(Exception, match="leads out"):
        transactions.commit(ops(spark, [("write", "link/x", "1")]), root)
    assert tree(root) == {} and not hidden(root)


def test_recovery_after_the_driver_died(spark, root, monkeypatch):
    transactions.commit(ops(spark, [("write", f"f{k}", f"old {k}") for k in range(6)]), root)
    before = tree(root)

    def breaks(path):
        if path == "f4":
            raise OSError("gone")

    monkeypatch.setattr(transactions, "roll_back", lambda *a: None)
    with pytest.raises(transactions.TransactionError):
        transactions.commit(ops(spark, [("write", f"f{k}", f"new {k}") for k in range(8)]), root, name="dead", before_apply=breaks)
    monkeypatch.undo()
    assert hidden(root) == [".transaction-dead"] and tree(root) != before
    with pytest.raises(transactions.TransactionError, match="is there already"):
        transactions.commit(ops(spark, [("write", "x", "1")]), root, name="dead")
    assert transactions.recover(spark, root) == [("dead", "rolled back")]
    assert tree(root) == before and transactions.recover(spark, root) == []
    os.makedirs(f"{root}/.transaction-done/old")
    open(f"{root}/.transaction-done/APPLIED", "w").close()
    assert transactions.recover(spark, root) == [("done", "kept")] and tree(root) == before


def test_a_task_that_runs_again_changes_nothing(spark, root):
    os.makedirs(root)
    open(f"{root}/a", "w").write("old")
    system, base = transactions.at(root)
    folder = f"{base}/.transaction-t"
    os.makedirs(f"{folder}/new")
    staged = hashlib.sha256(b"a").hexdigest()
    open(f"{folder}/new/{staged}", "w").write("new")
    row = {"kind": "write", "path": "a", "staged": staged, "existed": True}
    for _ in range(2):
        transactions._apply(None)(system, base, folder, row)
        assert tree(root) == {"a": b"new"}
    for _ in range(2):
        transactions._undo(system, base, folder, row)
        assert tree(root) == {"a": b"old"}


def test_moves_on_a_local_disk_are_no_renames_and_go_on_half_way(root):
    class Local(fs.LocalFileSystem):
        """Renames between folders wait for one another."""

        def move(self, src, dest):
            raise AssertionError(f"renamed {src}")

    system, folder = Local(), f"{root}/.transaction-t"
    for d in ("new", "old"):
        os.makedirs(f"{folder}/{d}")
    # Each as it is, and with a move that a task began and did not end: both names are there.
    for half in ("", "new", "old"):
        for kind, existed in (("write", True), ("write", False), ("delete", True)):
            name = f"{kind}-{existed}-{half}"
            row = {"kind": kind, "path": name, "staged": f"{name}-staged", "existed": existed}
            path, new, old = f"{root}/{name}", f"{folder}/new/{name}-staged", transactions._backup(folder, name)
            if existed:
                open(path, "w").write("old")
            if kind == "write":
                open(new, "w").write("new")
            if half and existed:
                os.makedirs(os.path.dirname(old), exist_ok=True)
                os.link(path, old)
            if half == "new" and kind == "write":
                if existed:
                    os.unlink(path)
                os.link(new, path)
            before = {k: v for k, v in tree(root).items() if k == name}
            for _ in range(2):
                transactions._apply(None)(system, root, folder, row)
                assert {k: v for k, v in tree(root).items() if k == name} == ({name: b"new"} if kind == "write" else {}), (name, before)
                assert not os.path.exists(new)
            for _ in range(2):
                transactions._undo(system, root, folder, row)
                assert {k: v for k, v in tree(root).items() if k == name} == ({name: b"old"} if existed else {}), (name, before)
    # Taken back half-way.
    open(f"{folder}/new/s", "w").write("new")
    os.link(f"{folder}/new/s", f"{root}/late")
    transactions._undo(system, root, folder, {"kind": "write", "path": "late", "staged": "s", "existed": False})
    assert "late" not in tree(root)


def test_nested_destinations_as_by_comparing_all(spark):
    """Odd paths too: empty, not from the root, with empty parts."""
    rng = random.Random(5)
    dests = ["/", "", "a", "a/b", "/a//b", "/a/b/", "/a/", "//", "/a/b", "/x", "/x/y/z", "/lone", None]
    dests += ["/" + "/".join(rng.choice("pqr") for _ in range(rng.randint(1, 5))) + rng.choice(["", "", ".md"]) for _ in range(60)]
    table = claims(spark, [{"dest": d} for d in dests])

    def up(dest):
        parts = [p for p in dest.split("/") if p]
        return {"/", *("/" + "/".join(parts[: k + 1]) for k in range(len(parts)))} - {dest}

    known = {d for d in dests if d is not None}
    outer = {o for d in known for o in up(d) if o in known}
    nested = outer | {d for d in known if up(d) & known}
    twice = {d for d in known if dests.count(d) > 1}
    assert {r.dest for r in ownership.conflicts(table).where("conflict").collect()} == nested | twice
    found = sinks.check_destinations(table.where("dest IS NOT NULL")).collect()
    assert {r.dest for r in found if r.problem == "nested"} == outer and {r.dest for r in found if r.problem == "duplicate"} == twice
    assert len(found) == len(outer) + len(twice)


def test_files_are_dealt_out_to_tasks(spark, root, tmp_path):
    """Operations that arrive in one small partition are carried out by several tasks."""
    from pyspark import TaskContext

    tasks = tmp_path / "tasks"
    tasks.mkdir()

    def note(path):
        (tasks / str(TaskContext.get().partitionId())).touch()

    change = ops(spark, [("write", f"d/f{k}", "x") for k in range(40)]).coalesce(1)
    assert transactions.commit(change, root, before_apply=note) == 40
    assert len(os.listdir(tasks)) > 2 and len(tree(root)) == 40
    paths = ops(spark, [("write", f"d/f{k}", "x") for k in range(40)]).coalesce(1)
    there = transactions.fingerprints(paths, root)
    assert there.count() == 40 and there.rdd.getNumPartitions() > 2
    assert transactions.commit(ops(spark, [("delete" if k % 2 else "write", f"d/f{k}", "y") for k in range(40)]).coalesce(1), root) == 40
    assert tree(root) == {f"d/f{k}": b"y" for k in range(0, 40, 2)} and not hidden(root)


def test_publish_again_and_again(spark, root):
    first = publishing.publish(claims(spark, [{"dest": "/a.md"}, {"dest": "/b.md", "body": "x"}, {"dest": "/g1", "grp": "g"}, {"dest": "/g2", "grp": "g"}]), root)
    assert first.operations == 4 and set(tree(root)) == {"s/a.md", "s/b.md", "s/g1", "s/g2"}
    again = publishing.publish(claims(spark, [{"dest": "/a.md"}, {"dest": "/b.md", "body": "y"}, {"dest": "/g1", "grp": "g"}, {"dest": "/g2", "grp": "g"}]), root)
    assert again.operations == 1 and tree(root)["s/b.md"] == b"y"
    open(f"{root}/s/g2", "w").write("changed by hand")
    open(f"{root}/s/own", "w").write("not ours")
    third = publishing.publish(claims(spark, [{"dest": "/a.md"}, {"dest": "/own", "body": "z"}, {"dest": "/c", "grp": "h"}, {"dest": "/own2", "grp": "h"}]), root, public=spark.createDataFrame([("s", "/own2")], "site string, dest string"))
    assert {k: v for k, v in tree(root).items()} == {"s/a.md": b"b", "s/g1": b"b", "s/g2": b"changed by hand", "s/own": b"not ours"}
    got = {(r.pathname, r.status) for r in third.manifest.collect()}
    assert got == {("/a.md", "emitted"), ("/own", "preserved"), ("/c", "group-skipped"), ("/own2", "preserved")}
    assert {(r.code, r.pathname) for r in third.findings.collect()} == {("artifact-preserved", "/own"), ("artifact-preserved", "/own2"), ("artifact-group-skipped", "/c")}
    assert [n for n in os.listdir(root) if n.startswith(".manifest-")] == [f".manifest-{n}" for n in [json.load(open(f"{root}/.manifest"))["name"]]]


def test_manifest_of_another_root_counts_for_nothing(spark, root, tmp_path):
    publishing.publish(claims(spark, [{"dest": "/a"}]), root)
    moved = str(tmp_path / "moved")
    os.rename(root, moved)
    assert publishing.read_manifest(spark, moved) is None and publishing.read_manifest(spark, moved, as_root=root).count() == 1
    out = publishing.publish(claims(spark, [{"dest": "/a", "body": "new"}]), moved)
    assert tree(moved) == {"s/a": b"b"} and [r.status for r in out.manifest.collect()] == ["preserved"]
    for junk in (b"", b"[]", b'{"version": 2}', b"\xff"):
        open(f"{moved}/.manifest", "wb").write(junk)
        assert publishing.read_manifest(spark, moved) is None


def test_failure_keeps_the_tree_but_redacts(spark, root):
    pages = spark.createDataFrame([("s", "/p.html", "<p>secret</p>"), ("s", "/q.html", "<p>open</p>")], "site string, dest string, body string")
    transactions.commit(pages.selectExpr("'write' AS kind", "concat(site, dest) AS path", "body"), root)
    edits = spark.createDataFrame(
        [("s", "/p.html", 0, False, 0, 0, "<!-- top -->"), ("s", "/p.html", 1, True, 3, 9, None), ("s", "/q.html", 0, False, 3, 7, "closed")],
        "site string, dest string, turn int, redaction boolean, start int, stop int, put string",
    )
    with pytest.raises(publishing.PublishError, match="conflict"):
        publishing.publish(claims(spark, [{"dest": "/a"}, {"dest": "/a"}]), root, pages=pages, edits=edits)
    assert tree(root) == {"s/p.html": b"<p></p>", "s/q.html": b"<p>open</p>"}
    transactions.commit(pages.selectExpr("'write' AS kind", "concat(site, dest) AS path", "body"), root)
    publishing.publish(claims(spark, [{"dest": "/a"}]), root, pages=pages, edits=edits)
    assert tree(root) == {"s/a": b"b", "s/p.html": b"<!-- top --><p></p>", "s/q.html": b"<p>closed</p>"}


def test_batches_update_the_tree(spark, root, tmp_path):
    rows = claims(spark, [{"dest": "/a", "body": "1"}, {"dest": "/b", "body": "2"}, {"dest": "/a", "body": "3"}])
    place = str(tmp_path / "claims")
    rows.coalesce(1).write.parquet(place)
    stream = spark.readStream.schema(rows.schema).parquet(place)

    def run():
        query = stream.writeStream.foreachBatch(publishing.publish_batches(root)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None

    run()
    assert tree(root) == {"s/a": b"3", "s/b": b"2"}
    claims(spark, [{"dest": "/c", "body": "4"}]).write.mode("append").parquet(place)
    run()
    assert tree(root) == {"s/a": b"3", "s/b": b"2", "s/c": b"4"}
    assert {r.pathname for r in publishing.read_manifest(spark, root).collect()} == {"/a", "/b", "/c"}


def test_policies_against_one_after_another(spark):
    rng = random.Random(3)
    dests = [f"/d{k}" for k in range(25)]
    outputs, public, routes = (set(rng.sample(dests, 6)) for _ in range(3))
    rows = [("s", k, rng.choice(dests), rng.choice("xyz"), rng.choice([publishing.OVERWRITE, publishing.WARN, publishing.SKIP])) for k in range(120)]
    there, owner, last, written, found = set(outputs), {}, {}, set(), []
    for _, k, dest, who, policy in rows:
        collides = dest in there or dest in owner or dest in routes or dest in public
        if policy == publishing.SKIP and collides:
            found += [("artifact-exists", k)] * (dest in there) + [("artifact-owner-retained", k)] * (dest in owner and owner[dest] != who)
            found += [("artifact-route-retained", k)] * (dest in routes) + [("artifact-public-retained", k)] * (dest in public)
            continue
        found += [("artifact-owner-overwritten", k)] * (dest in owner and owner[dest] != who) + [("artifact-route-overwritten", k)] * (dest in routes)
        found += [("artifact-public-overwritten", k)] * (dest in public) + [("artifact-exists", k)] * (dest in there and policy == publishing.WARN)
        there.add(dest)
        owner[dest], last[dest] = who, k
        written.add(k)
    table = spark.createDataFrame(rows, "site string, claim_id int, dest string, owner_name string, policy string").selectExpr("*", "dest AS served_key").repartition(4)
    files = spark.createDataFrame([("s", d, "output") for d in outputs] + [("s", d, "public") for d in public], "site string, dest string, kind string")
    decided, findings = publishing.arbitrate(table, spark.createDataFrame([("s", r) for r in routes], "site string, pathname string"), files)
    got = decided.collect()
    assert {r.claim_id for r in got if r.written} == written and {r.dest: r.claim_id for r in got if r.final} == last
    assert sorted((r.code, r.claim_id) for r in findings.collect()) == sorted(found)
