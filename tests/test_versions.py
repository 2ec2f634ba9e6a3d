import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tablefold.plans import graph
from tablefold.plans.graph import Commit
from tablefold.plans.versions import VersionStore, object_sizes
from tablefold.streaming.commits import change_counts, commit_stream


def history(edges):
    return {s: Commit(s, f"t{s}", tuple(p), float(s.strip("x"))) for s, p in edges.items()}


def test_graph():
    c = history({"1": [], "2": [], "3": ["1"], "4": ["2"], "5": ["3", "4"], "6": ["3"]})
    assert [x.sum for x in graph.newest_first(c, ["5", "6"])] == list("654321")
    assert graph.ancestors(c, ["6"]) == {"6", "3", "1"}
    assert graph.merge_base(c, ["5", "6"]) == "3" and graph.merge_base(c, ["5", "4"]) == "4"
    with pytest.raises(LookupError):
        graph.merge_base(c, ["6", "4"])
    assert graph.is_ancestor(c, "1", "6") and not graph.is_ancestor(c, "6", "6")


def test_names():
    c = history({"x1": [], "x2": ["x1"], "x3": ["x2"]})
    refs = {"heads/jan": "x3", "tags/jan": "x2", "tags/feb": "x2", "remotes/hub/feb": "x1", "remotes/hub/mar": "x1", "other/mar": "x2"}
    order = ["heads", "tags", "remotes", "other"]
    for name in ("jan", "feb", "mar"):
        first = min((r for r in refs if r.endswith(f"/{name}")), key=lambda r: order.index(r.split("/")[0]))
        assert graph.resolve(name, refs, c) == (first, refs[first])
    assert graph.resolve("feb", refs, c, exclude_tags=True)[0] == "remotes/hub/feb"
    assert graph.resolve("jan^", refs, c)[1] == "x2" and graph.resolve("jan~2", refs, c)[1] == "x1" == graph.resolve("x1", refs, c)[1]
    for wrong in ("jan~3", "none"):
        with pytest.raises(LookupError):
            graph.resolve(wrong, refs, c)
    assert graph.without_ancestors(c, ["x3", "x1"], ["x2"]) == ["x3"]


def test_what_to_send():
    c = history({"1": [], "2": ["1"], "3": ["2"], "4": ["3"]})
    assert graph.to_send(c, ["4"], [], depth=2) == (["1", "2", "3", "4"], {"t3", "t4"})
    assert graph.to_send(c, ["4"], ["2"]) == (["3", "4"], {"t3", "t4"})


@pytest.fixture
def store(spark, tmp_path):
    return VersionStore(spark, str(tmp_path / "store"))


def rows(spark, *lines):
    return spark.createDataFrame([tuple(x.split(",")) for x in lines], "a string, b string")


def test_commits_and_merges(spark, store):
    first = store.commit("main", rows(spark, "1,q", "2,w", "2,w"), "start", ["a"])
    assert store.commit("main", rows(spark, "2,w", "1,q"), "same", ["a"], if_changed=True) == first
    store.create_branch("side", "main")
    store.commit("side", rows(spark, "1,x", "2,w"), "side", ["a"])
    assert store.merge("main", "side") == store.resolve("side")  # forward
    store.commit("side", rows(spark, "1,y", "2,w"), "one", ["a"])
    store.commit("main", rows(spark, "1,x", "2,w", "3,n"), "two", ["a"])
    with pytest.raises(ValueError):
        store.merge("main", "side", fast_forward="only")
    both = store.merge("main", "side")
    assert store.commits[both].parents == (store.resolve("main^"), store.resolve("side")) and store.commits[both].message == 'Merge "side" into "main"'
    assert sorted(map(tuple, store.table("main")[0].collect())) == [("1", "y"), ("2", "w"), ("3", "n")]
    assert {r.a: r.status for r in store.diff("main").collect()} == {"1": "modified"}
    assert [c.message for c in store.log("main")][-1] == "start" and store.reflog("heads/main")[0]["action"] == "merge"
    assert store.profile("main").count() == 2
    store.tag("v1", "main")
    store.reset("main", "main^")
    assert store.resolve("tags/v1") == both and store.branches("s*") == ["side"]
    store.move_branch("side", "other")
    assert store.branches() == ["main", "other"]
    assert object_sizes(store).where("kind = 'commits'").first().objects == len(store.commits)
    assert all(c.zone for c in store.commits.values()) and store.show("commit", "other")["message"] == "one"
    assert [(r.row, r.a) for r in store.rows_at("tags/v1", [2, 9]).collect()] == [(2, "3")] and store.blocks("tags/v1", 1).count() == 0
    assert [(r.block, r.rows) for r in store.block_index("tags/v1").collect()] == [(0, 3)] and store.show("block", "tags/v1").count() == 3
    assert {(r.new_row, r.old_row) for r in store.diff_offsets("tags/v1", "main").collect()} == {(0, 0)}
    assert [c.sum for c, _ in store.travel("heads/main")][0] == store.resolve("main") and store.objects("profiles")
    assert store.commits[both].table in dict(map(reversed, store.find_object(store.commits[both].table[:6])))


def test_conflicts_need_a_resolution_each(spark, store):
    store.commit("main", rows(spark, "1,q", "2,w"), "start", ["a"])
    store.create_branch("side", "main")
    store.commit("main", rows(spark, "1,x", "2,x"), "ours", ["a"])
    store.commit("side", rows(spark, "1,y", "2,y"), "theirs", ["a"])
    one = spark.createDataFrame([("1", "z", False)], "a string, b string, drop boolean")
    for some in (None, one):
        with pytest.raises(ValueError, match="conflict"):
            store.merge("main", "side", resolutions=some)
    store.merge("main", "side", resolutions=one.unionAll(spark.createDataFrame([("2", "", True)], one.schema)))
    assert list(map(tuple, store.table("main")[0].collect())) == [("1", "z")]
    store.create_branch("third", "main")
    store.commit("side", rows(spark, "1,a", "2,b"), "more", ["a"])
    done = store.merge("main", "side", "third", merged=rows(spark, "1,whole"))
    assert len(store.commits[done].parents) == 3 and store.table("main")[0].count() == 1


def test_refs_files_and_reapply(spark, store, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,b\n1,q\n")
    store.configure("main", str(path), ["a"])
    first = store.commit_files("one")["main"]
    assert store.commit_files("again") == {} and store.configured("in[.]csv$").keys() == {"main"} == store.configured(value=str(path)).keys() and not store.configured("x$")
    path.write_text("a,b\n1,q\n2,w\n")
    os.utime(path, (1e9, 1e9))
    second = store.commit_files("two")["main"]
    assert store.table("main")[0].count() == 2 and store.profile_ancestors("main") == [second, first]
    third = store.reapply("main", first)
    assert store.commits[third].table == store.commits[first].table and store.commits[third].parents == (second,) and store.reapply("main", first) == third
    store.tag("v1", first)
    store.copy_ref("tags/v1", "tags/v2")
    store.rename_ref("tags/v2", "remotes/hub/main")
    store.add_remote("hub", str(tmp_path / "hub"))
    assert store.remotes_with(first) == ["hub"] and store.remotes_with(second) == []
    store.rename_remote("hub", "base")
    store.set_remote("base", branches=["m*"])
    assert store.remote("base") == {"url": str(tmp_path / "hub"), "branches": ["m*"]} and store.refs_like("remotes/") == {"remotes/base/main": first}
    store.remove_remote("base")
    store.delete_tag("v1")
    assert store.refs_like("", but_not="heads/") == {} and store.has_reflog("tags/v1") and not store.has_reflog("tags/v9")
    assert {r.ref: r.action for r in store.latest().collect()}["heads/main"] == "reapply"
    assert VersionStore.discover(spark, store.meta / "tables").meta == store.meta
    with pytest.raises(ValueError):
        VersionStore(spark, "hdfs://host/data")
    assert all(here for _, here in store.history("main"))


def test_prune_and_doctor(spark, store):
    for i in range(3):
        store.commit("one", rows(spark, f"1,{i}"), str(i), ["a"])
    gone = store.resolve("one")
    store.reset("one", "one^")
    store.commit("two", rows(spark, "9,9"), "two", ["a"])
    lost = store.resolve("two")
    store.delete_branch("two")
    assert store.prune()["commits"] == sorted([gone, lost]) and len(store.tables) == 2
    assert store.diagnose() == []
    good = store.resolve("one")
    store.create_branch("side", "one")
    store.commit("side", rows(spark, "1,1", "2,2"), "side", ["a"])
    store.commit("one", rows(spark, "1,1", "3,3"), "one more", ["a"])
    merged = store.merge("one", "side")
    table = store.commits[good].table
    rows(spark, "1,1", "1,0").write.mode("overwrite").parquet(store._path(table))
    (issue,) = store.diagnose()
    assert (issue.commit, issue.issue, issue.remedy, issue.ancestors, issue.descendants) == (good, "keys are repeated", "ingest again", 1, 3)
    assert store.wrong_index(store.resolve("side")) is None
    store.repair()
    assert store.diagnose() == [] and store.table("side^")[0].count() == 1
    assert len(store.commits[store.resolve("one")].parents) == 2 and store.resolve("one") != merged
    path = store._path(store.commits[store.resolve("side")].table)
    spark.createDataFrame(store.stored("side").collect(), store.stored("side").schema).withColumn("__row", F.col("__row") + 1).write.mode("overwrite").parquet(path)
    assert [i.issue for i in store.diagnose()] == ["row numbers don't match"]
    store.reindex("side")
    assert store.diagnose() == []
    tables = store._read("tables")
    store._write("tables", {t: {**m, "pk": ["gone"] if t == path.rpartition("/")[2] else m["pk"]} for t, m in tables.items()})
    assert {(i.issue, i.remedy) for i in store.diagnose()} == {("key columns are missing: gone", "reset key")}


def test_transactions(spark, store):
    store.commit("beta", rows(spark, "1,q"), "b", ["a"])
    t = store.begin()
    store.stage(t, "alpha", rows(spark, "1,x"), "new alpha", ["a"])
    store.stage(t, "beta", rows(spark, "1,y"), "new beta", ["a"])
    assert {b: old is not None for b, (_, old) in store.transaction_diff(t).items()} == {"alpha": False, "beta": True}
    store.finish(t)
    assert store.log("alpha")[0].message == f"commit [tx/{t}]\nnew alpha" and len(store.log("beta")) == 2 and store.staged(t) == {}
    store.commit("alpha", rows(spark, "1,n"), "n", ["a"])
    again = store.reapply_transaction(t)
    assert again["alpha"] != store.log("alpha")[1].sum and store.table("alpha")[0].first().b == "x" and len(store.log("alpha")) == 3
    u = store.begin()
    store.stage(u, "gamma", rows(spark, "1,z"), "g", ["a"])
    assert len(store.collect_garbage(ttl=0)["commits"]) >= 1 and u not in dict(store.transactions())


def test_sync(spark, store, tmp_path):
    other = VersionStore(spark, str(tmp_path / "other"))
    for i in range(3):
        store.commit("main", rows(spark, f"1,{i}"), str(i), ["a"])
    assert other.fetch(store, "origin", depth=1) == {"main": "new"} and len(other.commits) == 3 and len(other.tables) == 1
    old = store.resolve("main^")
    assert [here for _, here in other.history("origin/main")] == [True, False, False]
    assert other.fetch_tables(store, old) == [store.commits[old].table] and other.fetch_tables(store, old) == []
    assert other.fetch(store, "origin") == {"main": "tables"} and len(other.tables) == 3
    assert other.fetch(store, "origin") == {"main": "up to date"}
    store.tag("v1", "main")
    other.tag("v1", "origin/main^")
    assert other.fetch(store, "origin", tags=True)["tags/v1"] == "would clobber" and other.fetch(store, "origin", tags=True, force=True)["tags/v1"] == "fast-forward"
    other.create_branch("main", "origin/main")
    other.commit("main", rows(spark, "1,2", "2,5"), "theirs", ["a"])
    assert other.push(store, "main") == "fast-forward" and store.table("main")[0].count() == 2
    store.commit("main", rows(spark, "1,7", "2,5"), "ours", ["a"])
    other.commit("main", rows(spark, "1,2", "2,6"), "theirs", ["a"])
    assert other.push(store, "main") == "rejected"
    other.pull(store, "origin", "main")
    assert sorted(map(tuple, other.table("main")[0].collect())) == [("1", "7"), ("2", "6")]
    t = other.begin()
    other.stage(t, "next", rows(spark, "5,5"), "next", ["a"])
    assert other.push_transaction(store, t) == {"next": "new"} and store.finish(t).keys() == {"next"}
    other.push_delete(store, "next")
    assert store.branches() == ["main"]


def test_stream(spark, store, tmp_path):
    source = tmp_path / "in"
    rows(spark, "1,q", "2,w").coalesce(1).write.parquet(str(source))
    for more in ([], ["2,e", "3,r"]):
        if more:
            rows(spark, *more).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("a string, b string").parquet(str(source))
        commit_stream(stream, store, "main", ["a"], str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, store.table("main")[0].collect())) == [("1", "q"), ("2", "e"), ("3", "r")] and len(store.log("main")) == 2
    events = spark.sql("SELECT timestamp '2024-01-01 00:10:00' AS ts, 'x' AS kind UNION ALL SELECT timestamp '2024-01-01 00:50:00', 'x'")
    assert change_counts(events, "ts", "kind").first().rows == 2


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    r = __spark_entry__.entry(spark).first()
    assert r.rows_added > 0 and r.rows_removed > 0 and r.rows_modified > 0
