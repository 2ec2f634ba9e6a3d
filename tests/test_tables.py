"""Operators on drawn tables, each held against a plain version in Python."""

import io
import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablefold.functions import canon
from tablefold.operators import coldiff, history, ingest, profile, rowdiff
from tablefold.operators.merge import merge
from tablefold.sources import csvio, mutate


def frame(spark, columns, rows):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{c}` string" for c in columns))


def draw(seed, keys, columns, values="xyz"):
    """A table {key: cells} of some of the keys."""
    r = random.Random(seed)
    return {k: tuple(r.choice(values) for _ in columns) for k in keys if r.random() < 0.8}


def lines(table):
    return [(k, *cells) for k, cells in table.items()]


KEYS = [f"k{i:02d}" for i in range(40)]


# Differences


def plain_diff(new, old, same_columns=True):
    out = {k: "added" for k in new.keys() - old.keys()} | {k: "removed" for k in old.keys() - new.keys()}
    return out | {k: "modified" for k in new.keys() & old.keys() if not same_columns or new[k] != old[k]}


@pytest.mark.parametrize("seed", range(3))
def test_row_diff(spark, seed):
    new, old = draw(seed, KEYS, "uv"), draw(seed + 50, KEYS, "uv")
    n, o = frame(spark, ["id", "u", "v"], lines(new)), frame(spark, ["id", "u", "v"], lines(old))
    got = {r.id: r.status for r in rowdiff.row_diff(n, o, ["id"]).collect()}
    assert got == plain_diff(new, old)
    every = {r.id: r.status for r in rowdiff.row_diff(n, o, ["id"], unchanged=True).collect()}
    assert every == plain_diff(new, old) | {k: "unchanged" for k in new.keys() & old.keys() if new[k] == old[k]}
    other_order = {r.id: r.status for r in rowdiff.row_diff(n, o.select("v", "id", "u"), ["id"]).collect()}
    assert other_order == plain_diff(new, old, same_columns=False)
    assert rowdiff.row_diff(n, o, ["id"], ["u"]).count() == 0  # keys of other names match nothing
    with pytest.raises(ValueError):
        rowdiff.row_diff(n, o, ["nothing"])


def test_without_a_key_rows_are_added_or_removed(spark):
    new, old = {("a", "1"), ("b", "2"), ("c", "3")}, {("b", "2"), ("c", "4")}
    d = rowdiff.row_diff(frame(spark, "pq", new), frame(spark, "pq", old), [])
    assert {(r.status, r.p, r.q) for r in d.collect()} == {("added", *r) for r in new - old} | {("removed", *r) for r in old - new}


def test_null_keys_match(spark):
    d = spark.createDataFrame([(None, 1), (2, None)], "a int, b int")
    assert rowdiff.row_diff(d, d, ["a"]).count() == 0


def test_cells_of_changed_rows(spark):
    new, old = draw(5, KEYS, "uvw"), draw(6, KEYS, "uv")
    n, o = frame(spark, ["id", "u", "v", "w"], lines(new)), frame(spark, ["id", "v", "u"], [(k, v, u) for k, (u, v) in old.items()])
    both = new.keys() & old.keys()
    want = {(k, c, old[k][i] if i < 2 else None, new[k][i]) for k in both for i, c in enumerate("uvw") if i == 2 or new[k][i] != old[k][i]}
    assert {tuple(r) for r in rowdiff.cell_diff(n, o, ["id"]).select("id", "column", "old", "new").collect()} == want
    for r in rowdiff.combined_rows(n, o, ["id"]).collect():
        k = r.id[0]
        assert [r.u, r.v, r.w] == [[new[k][i]] if i == 2 or new[k][i] == old[k][i] else [new[k][i], old[k][i]] for i in range(3)]


def test_summaries_and_labelled_lines(spark):
    new, old = {"p": ("1",), "q": ("2",), "r": ("3",)}, {"q": ("2",), "r": ("9",), "s": ("4",)}
    n, o = frame(spark, ["id", "val"], lines(new)), frame(spark, ["id", "val"], lines(old))
    line = lambda *x, **how: rowdiff.summary(*x, **how).select(rowdiff.summary_line()).first()[0]
    assert line(n, o, ["id"]) == "rows: +1/-1/m1" and line(n, n, ["id"]) == ""
    assert line(n.withColumn("more", F.lit("")), o, ["id"]) == "rows: +1/-1/m2; columns: +1"
    assert line(n, n.drop("val"), ["id", "val"], old_pk=["id"]).endswith("primary key: id->id,val")
    got = [(r.label, *r.cells) for r in rowdiff.labelled(n, o, ["id"]).orderBy("section", "key", "line").collect()]
    heads = [("COLUMNS IN old", "id", "val"), ("COLUMNS IN new", "id", "val"), ("PRIMARY KEY IN old", "true", ""), ("PRIMARY KEY IN new", "true", "")]
    assert got == [*heads, ("ADDED IN new", "p", "1"), ("BASE ROW FROM old", "r", "9"), ("MODIFIED IN new", "r", "3"), ("REMOVED IN new", "s", "4")]


def test_small_changes_of_floats_count(spark):
    schema = "id int, d double, f float"
    old_lines = [(1, 1e-6, 0.5), (2, 2e-6, 0.25), (3, 1e40, 0.125), (4, None, 1e-7), (5, 0.1, None)]
    changed = [(1, 3e-6, 0.5), (2, 2e-6, 0.25), (3, 2e40, 0.125), (4, float("nan"), 1.5e-7), (5, 0.1 + 2**-56, None)]
    old, new = spark.createDataFrame(old_lines, schema), spark.createDataFrame(changed, schema)
    assert {(r.id, r.status) for r in rowdiff.row_diff(new, old, ["id"]).collect()} == {(i, "modified") for i in (1, 3, 4, 5)}
    assert {(r.id, r.column) for r in rowdiff.cell_diff(new, old, ["id"]).collect()} == {(1, "d"), (3, "d"), (4, "d"), (4, "f"), (5, "d")}
    assert ingest.table_sum(new, ["id"]) != ingest.table_sum(old, ["id"])
    m = merge(old, [new, old.where("id < 5")], ["id"])
    assert m.rows.schema["d"].dataType == old.schema["d"].dataType and m.rows.schema["id"].dataType == old.schema["id"].dataType
    got = {r.id: (r.d, r.f) for r in m.resolved().collect()}
    assert got[1] == (3e-6, 0.5) and got[3] == (2e40, 0.125) and math.isnan(got[4][0]) and [r.id for r in m.conflicts().collect()] == [5]


# Columns


def plain_kept(base, layer):
    """A longest run of common columns, in the layer's order, whose places in base ascend."""
    common = [c for c in layer if c in base]
    best = max((s for n in range(len(common) + 1) for s in itertools.combinations(common, n) if [base.index(c) for c in s] == sorted(base.index(c) for c in s)), key=len)
    return len(best)


@pytest.mark.parametrize("seed", range(8))
def test_columns(seed):
    r = random.Random(seed)
    base, layer = r.sample("abcdefgh", r.randint(2, 6)), r.sample("abcdefgh", r.randint(2, 6))
    d = coldiff.compare_columns(base, [layer])
    assert sorted(d.names) == sorted({*base, *layer}) and [c for c in d.names if c in layer] == layer
    assert set(d.added[0]) == set(layer) - set(base) and set(d.removed[0]) == set(base) - set(layer)
    assert len(d.moved[0]) == len(set(base) & set(layer)) - plain_kept(base, layer)
    pk = r.sample(layer, 2)
    assert coldiff.compare_columns(base, [layer], pk).names[:2] == pk


def test_a_moved_column_is_named_by_its_neighbour():
    d = coldiff.compare_columns("pqr", [list("rpq")])
    assert d.names == ["r", "p", "q"] and d.moved[0] == {0: (-1, 2)}  # it stood behind q


# Merges


def plain_merge(base, layers):
    """{key: (cells, unresolved columns, kind)} for layers with base's columns."""
    out = {}
    for k in set(base).union(*layers):
        rows = [x.get(k) for x in layers]
        own = base.get(k)
        removed = own is not None and None in rows
        changed = any(r is not None and r != own for r in rows)
        cells, clash = [], []
        for i in range(2):
            values = {r[i] for r in rows if r is not None and (own is None or r[i] != own[i])}
            before = own[i] if own else ""
            bad = len(values) > 1 or bool(values) and removed
            clash += ["uv"[i]] if bad else []
            cells.append(before if bad or not values else values.pop())
        out[k] = (tuple(cells), clash, "dropped" if removed and not changed else "resolved" if not removed and not clash else "conflict")
    return out


@pytest.mark.parametrize("seed, n", [(1, 2), (2, 2), (3, 3)])
def test_merge(spark, seed, n):
    base = draw(seed, KEYS, "uv", "ab")
    layers = []
    for i in range(n):
        r = random.Random(100 * seed + i)
        layers.append({k: tuple(c if r.random() < 0.7 else r.choice("ab") for c in v) for k, v in base.items() if r.random() < 0.85} | draw(seed + 10 * i + 5, [f"n{j}" for j in range(6)], "uv", "ab"))
    tables = [frame(spark, ["id", "u", "v"], lines(t)) for t in (base, *layers)]
    m = merge(tables[0], tables[1:], ["id"])
    want = plain_merge(base, layers)
    got = {r.id: ((r.u, r.v), r.unresolved, "dropped" if r.dropped else "resolved" if r.resolved else "conflict") for r in m.rows.collect()}
    assert got == want
    open_ = sorted(k for k, v in want.items() if v[2] == "conflict")
    assert open_ and {r.id for r in m.conflicts().collect()} == set(open_)
    named = spark.createDataFrame([(k, "r", "s", k == open_[0]) for k in open_], "id string, u string, v string, drop boolean")
    done = {r.id: (r.u, r.v) for r in m.result(named).collect()}
    assert done == {k: v[0] for k, v in want.items() if v[2] == "resolved"} | {k: ("r", "s") for k in open_[1:]}
    for some in (named.where(F.col("id") != open_[-1]), None):  # no conflict goes in silence
        with pytest.raises(Exception, match="has no resolution"):
            m.result(some).collect()
    label = [(r.has_base, r.id, r.line, r.label) for r in m.lines(["base", *"pqr"[:n]]).orderBy("has_base", "id", "line").collect()]
    assert [x[1] for x in label if x[3] == "RESOLUTION"] == sorted(open_, key=lambda k: (k in base, k))


def test_merge_of_columns(spark):
    base = frame(spark, ["id", "u", "v"], [("1", "a", "b"), ("2", "c", "d")])
    wide = frame(spark, ["id", "u", "v", "w"], [("1", "a", "b", "new"), ("2", "c", "e", "")])
    narrow = frame(spark, ["id", "u"], [("1", "z"), ("2", "c")])
    m = merge(base, [wide, narrow], ["id"])
    got = {r.id: ((r.u, r.v, r.w), r.unresolved) for r in m.rows.collect()}
    assert got == {"1": (("z", "", "new"), []), "2": (("c", "d", ""), ["v"])}  # a cell changed, while its column went
    proposed = {r.id: list(r.cells) for r in m.lines(["base", "wide", "narrow"]).where("label = 'RESOLUTION'").collect()}
    assert proposed == {"2": [dict(zip(["id", "u", "v", "w"], ["2", "c", "d", ""]))[c] for c in m.columns.names]}
    only = merge(base, [base, narrow], ["id"])
    assert sorted(map(tuple, only.result().collect())) == [("1", "z"), ("2", "c")]
    mixed = merge(base, [base.withColumn("id", F.col("id").cast("int"))], ["id"])
    assert mixed.rows.schema["id"].dataType.simpleString() == "string" and mixed.conflicts().count() == 0


# Profiles

#: Percentiles whose rounding follows a rule of its own (fixed values): of 0..68, and of five values with repeats.
PERCENTILES = [
    (range(69), [3, 7, 10, 14.69, 17, 21.69, 24, 28.69, 31, 34, 38, 41, 45, 48, 52.69, 55, 59.69, 62, 66.69], 34),
    ([1] * 20 + [3] * 50 + [5] * 20 + [6] * 10 + [9] * 5, [1] * 3 + [3] * 10 + [5] * 4 + [6, 9], 3),
    (range(5), None, 2),
]


@pytest.mark.parametrize("numbers, want, median", PERCENTILES)
def test_percentiles(spark, numbers, want, median):
    r = profile.profile(spark.createDataFrame([(str(n),) for n in numbers], "x string")).first()
    assert r.percentiles == want and r.median == median


def round2(x):
    return math.copysign(math.floor(abs(x) * 100 + 0.5) / 100, x)


def test_profile(spark):
    r = random.Random(9)
    rows = [(str(r.randint(-50, 50)) if r.random() < 0.9 else "", r.choice(["to", "be", "or", "nöt", ""]), f"{r.random():.3f}" if i else "1.0d", "", "-inf" if i == 3 else "NaN" if i == 4 else "0x1p4") for i in range(60)]
    got = {x["column"]: x for x in profile.profile(frame(spark, ["n", "s", "mixed", "none", "odd"], rows)).collect()}
    for j, c in enumerate(["n", "s", "mixed", "none"]):
        values = [row[j] for row in rows if row[j]]
        sizes = [len(v.encode()) for v in values]
        x = got[c]
        assert (x.na_count, x.min_str_len, x.max_str_len) == (60 - len(values), min(sizes, default=0), max(sizes, default=0))
        assert x.avg_str_len == (math.floor(sum(sizes) / len(sizes) + 0.5) if sizes else 0)
        if c == "n":
            numbers = [float(v) for v in values]
            mean = round2(sum(numbers) / len(numbers))
            assert (x.min, x.max, x.mean) == (min(numbers), max(numbers), mean)
            assert x.std_deviation == round2(math.sqrt(sum((v - mean) ** 2 for v in numbers) / 60))
        else:
            assert x.min is None and x.mean is None and x.percentiles is None
        top = sorted(Counter(values).items(), key=lambda t: (-t[1], t[0].encode()))[:20]
        assert [tuple(t) for t in x.top_values or []] == (top if top and top[0][1] > 1 else [])
    assert (got["odd"].min, got["odd"].max) == (float("-inf"), 16.0)


def test_profile_differences(spark):
    count = lambda counts: profile.profile(spark.createDataFrame([(v, "c") for v, n in counts.items() for _ in range(n)], "x string, y string"))
    new, old = count({"A": 12, "B": 7, "C": 6}), count({"B": 9, "A": 8, "D": 8})
    d = [tuple(r) for r in profile.top_values_diff(new, old).where("column = 'x'").orderBy("position").select("value", "old_count", "new_count", "old_pct", "new_pct").collect()]
    assert d == [("B", 9, 7, 36, 28), ("A", 8, 12, 32, 48), ("D", 8, 0, 32, 0), ("C", 0, 6, 0, 24)]
    assert all(r.unchanged for r in profile.scalar_diff(new, new).collect())
    assert {r.column: r.status for r in profile.table_diff(new, old).collect()} == {"x": "changed", "y": "unchanged"}
    assert profile.table_diff(new, new).count() == 0
    assert {r.column: r.status for r in profile.table_diff(None, old).collect()} == {"x": "removed", "y": "removed"}
    assert {r.column: r.status for r in profile.table_diff(new.where("column = 'x'"), old.where("column = 'y'")).collect()} == {"x": "added", "y": "removed"}


def test_numbers(spark):
    want = {"7": 7.0, "-0.5e1": -5.0, "1e999": None, "2f": None, "": None, "Infinity": float("inf"), "-inf": float("-inf"), "0x1.8p1": 3.0, "-0X10P-4": -1.0, "0x1": None, "0x1p99999": None, "1_0": None, "0xp1": None}
    d = spark.createDataFrame([(v,) for v in [*want, "nAn"]], "v string").select("v", canon.parsed(F.col("v")).alias("n"), canon.displayed(F.col("v").try_cast("double")).alias("t"))
    got = {r.v: r for r in d.collect()}
    assert {v: got[v].n for v in want} == want and math.isnan(got["nAn"].n)
    assert got["7"].t == "7" and spark.range(1).select(canon.displayed(F.lit(100.25)), canon.displayed(F.lit(100.0), 0)).first()[:] == ("100.25", "100")


# Ingest, history


@pytest.mark.parametrize("parts", [1, 7])
def test_ingest(spark, parts):
    rows = [(f"{i:04d}", str(i * 7 % 100)) for i in range(620)]
    d = frame(spark, ["id", "x"], [*rows, *rows[:200]]).repartition(parts)
    placed = ingest.blocks(ingest.one_per_key(d, ["id"]), ["id"])
    assert sorted((r.row, r.id, r.block, r.offset) for r in placed.collect()) == [(i, f"{i:04d}", i // 255, i % 255) for i in range(620)]
    assert sorted(r.row for r in ingest.rows_at(d.distinct(), ["id"], [0, 619, 620]).collect()) == [0, 619]
    one = d.distinct()
    assert ingest.table_sum(one, ["id"]) == ingest.table_sum(one.orderBy("x"), ["id"]) != ingest.table_sum(one.withColumnRenamed("x", "y"), ["id"])
    least = frame(spark, ["id", "x"], [("1", "b"), ("1", "a"), ("", "c"), ("2", "d")])
    assert sorted(map(tuple, ingest.one_per_key(least, ["id"]).collect())) == [("", "c"), ("1", "a"), ("2", "d")]
    assert ingest.one_per_key(least, ["id"], drop_empty_keys=True).count() == 2
    assert ingest.numbered(spark.createDataFrame([], "a string"), ["a"]).count() == 0
    assert [(r.id, r.rows) for r in ingest.duplicate_keys(least, ["id"]).collect()] == [("1", 2)]


def test_row_sums_follow_cells_and_order(spark):
    s = lambda columns, *row: frame(spark, columns, [row]).select(canon.row_sum(frame(spark, columns, [row]))).first()[0]
    assert s("ab", "1", "q") == s("xy", "1", "q") != s("ab", "q", "1")
    assert s("ab", "ab", "c") != s("ab", "a", "bc")


def test_history(spark):
    r = random.Random(2)
    parents = {i: sorted({r.randint(max(0, i - 20), max(0, i - 5)) for _ in range(r.choice([1, 1, 2]))}) if i > 4 and r.random() < 0.93 else [] for i in range(60)}
    up = defaultdict(set)
    for i in range(60):
        up[i] = {i}.union(*(up[p] for p in parents[i]))
    edges = spark.createDataFrame([(i, p) for i, ps in parents.items() for p in ps], "child long, parent long")
    sums = lambda *x: spark.createDataFrame([(i,) for i in x], "sum long")
    found = lambda d: {x.sum for x in d.collect()}
    assert found(history.ancestors(edges, sums(59, 40))) == up[59] | up[40]
    assert found(history.unreachable(sums(*range(60)), edges, sums(55))) == set(range(60)) - up[55]
    assert found(history.to_send(edges, sums(59, 58), sums(50))) == (up[59] | up[58]) - up[50]
    pairs = [(i, j) for i in range(50, 60) for j in range(i + 1, 60)]
    got = {(x.a, x.b): x.base for x in history.merge_bases(edges, spark.createDataFrame(pairs, "a long, b long")).collect()}
    for a, b in pairs:
        common = up[a] & up[b]
        best = [c for c in common if not any(c in up[d] - {d} for d in common)]
        assert got[a, b] == max(best, default=None)


def test_long_history_is_sent_by_one_join(spark):
    edges = spark.range(1, 31).selectExpr("id AS child", "id - 1 AS parent")
    sums = lambda *x: spark.createDataFrame([(i,) for i in x], "sum long")
    sent = history.to_send(edges, sums(30), sums(20))
    assert sorted(x.sum for x in sent.collect()) == list(range(21, 31))
    assert sent._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # not one a step, each with all that is held


def test_long_history_takes_few_rounds(spark):
    up = {i: {*range(i % 2, i + 1, 2), *(j for m in range(i % 2, i + 1, 2) if m % 11 == 0 for j in range(m))} for i in range(60)}
    edges = spark.range(60).selectExpr("id AS child", "explode(array(id - 2, if(id % 11 = 0, id - 1, -1))) AS parent").where("parent >= 0")
    sc = spark.sparkContext
    sc.setJobGroup("rounds", "")
    got = history.merge_bases(edges, spark.createDataFrame([(59, 58), (7, 40), (1, 2)], "a long, b long")).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("rounds"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert {(x.a, x.b): x.base for x in got} == {(a, b): max(up[a] & up[b], default=None) for a, b in [(59, 58), (7, 40), (1, 2)]}
    assert jobs < 90, jobs  # 30 steps a branch


def test_history_in_circles(spark):
    r = random.Random(5)
    pairs = [(f"c{i}", f"c{r.randrange(25)}") for i in range(25) for _ in range(r.choice([0, 1, 2]))] + [("x", "y"), ("y", "z"), ("z", "x"), ("z", "z")]
    up = {s: {s} for s in [*(f"c{i}" for i in range(25)), *"xyz", "alone"]}
    for _ in up:
        for child, parent in pairs:
            up[child] |= up[parent]
    edges = spark.createDataFrame(pairs, "child string, parent string")
    got = history.reach(edges, spark.createDataFrame([(s, s) for s in up], "start string, sum string"))
    assert sorted(map(tuple, got.collect())) == sorted((s, t) for s in up for t in up[s])


# Sources


def test_csv(spark, tmp_path):
    assert csvio.named(["", "a", "unnamed__1", ""]) == ["unnamed__2", "a", "unnamed__1", "unnamed__3"]
    path = tmp_path / "in.csv"
    path.write_text('one;;two\n7;"say ""hi""\nnow";\n\n8;;"x;y"\n')
    d = csvio.read_csv(spark, str(path), ";")
    assert d.columns == ["one", "unnamed__1", "two"] and sorted(map(tuple, d.collect())) == [("7", 'say "hi"\nnow', ""), ("8", "", "x;y")]
    csvio.write_csv(d, str(tmp_path / "out"))
    assert sorted(map(tuple, csvio.read_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, d.collect()))
    path.write_text("one,two\n7\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        csvio.read_csv(spark, str(path)).collect()
    piped = csvio.read_stdin(spark, str(tmp_path), stream=io.BytesIO("k,v\n2,b\n1,é\n2,a\n".encode()))
    assert sorted(map(tuple, piped.collect())) == [("1", "é"), ("2", "a"), ("2", "b")]
    path.write_text("k,v\n2,b\n1,c\n2,a\n")
    assert sorted((r.row, r.k, r.v) for r in csvio.preview(spark, str(path), ["k"]).collect()) == [(0, "1", "c"), (1, "2", "a")]


def test_mutators(spark):
    d = spark.range(10_000).selectExpr("id", "cast(id AS string) AS a", "cast(id AS string) AS b")
    changed = rowdiff.row_diff(mutate.modify_rows(d, ["id"], ["a", "b"], 0.02), d, ["id"]).count()
    assert 120 < changed < 280
    assert 8800 < mutate.remove_rows(d, ["id"], 0.1).count() < 9200
    assert mutate.move_column(d, "b", 0).columns == ["b", "id", "a"]
    more = mutate.add_rows(d, ["id"], 0.1)
    assert 10_800 < more.count() == more.select("id").distinct().count() and rowdiff.row_diff(more, d, ["id"]).where("status <> 'added'").count() == 0
    assert mutate.add_columns(d.withColumnRenamed("a", "col_a"), ["id"], 2).columns == ["id", "col_a", "b", "col_b", "col_c"]
    assert [mutate.column_name(i) for i in (0, 25, 26, 27, 701, 702)] == ["col_a", "col_z", "col_aa", "col_ab", "col_zz", "col_aaa"]
    assert "id" in mutate.remove_columns(d, 1, ["id"]).columns and len(mutate.remove_columns(d, 1, ["id"]).columns) == 2
