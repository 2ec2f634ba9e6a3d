"""A folder of table versions: Parquet data under content sums, commits, refs, logs and transactions.

Data is read and written by Spark, under ``data`` (any path that all executors
reach). A stored table holds, besides its columns, each row's number in key order
and the sums of its key and of the row (its index), so that reads by position and
checks need no new pass over the whole. Metadata is small: JSON under ``meta``, a
folder of the driver's. One writer at a time is assumed; files are replaced whole,
by a rename.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canon import row_sum
from ..operators import ingest, profile, rowdiff
from ..operators.merge import Merge, merge
from ..sources import csvio
from . import graph
from .graph import Commit

TRANSACTION_TTL = 30 * 24 * 3600


#: Columns of a stored table that are no part of it: row number, sum of the key, sum of the row.
ROW, KEY_SUM, ROW_SUM = "__row", "__key_sum", "__row_sum"


@dataclass(frozen=True)
class Issue:
    """What is wrong with a commit, what mends it (remove, reset key, ingest again), and how much history stands on both sides."""

    commit: str
    issue: str
    remedy: str
    ancestors: int
    descendants: int


class VersionStore:
    def __init__(self, spark: SparkSession, data: str, meta: str | os.PathLike | None = None):
        if meta is None and "://" in data and not data.startswith("file://"):
            raise ValueError(f"{data} is no folder of the driver's: name one for the metadata (meta=...)")
        self.spark, self.data, self.meta = spark, data.rstrip("/"), Path(meta or data.removeprefix("file://"))
        self.meta.mkdir(parents=True, exist_ok=True)

    @classmethod
    def discover(cls, spark: SparkSession, start: str | os.PathLike) -> VersionStore:
        """The store whose folder is start or the nearest one above it."""
        for folder in [Path(start).resolve(), *Path(start).resolve().parents]:
            if (folder / "commits.json").exists():
                return cls(spark, str(folder))
        raise LookupError(f"no store at or above {start}")

    # Metadata files

    def _read(self, name: str) -> dict:
        path = self.meta / f"{name}.json"
        return json.loads(path.read_text()) if path.exists() else {}

    def _write(self, name: str, content: dict) -> None:
        path = self.meta / f"{name}.json"
        temp = path.with_suffix(f".{uuid.uuid4().hex}")
        temp.write_text(json.dumps(content))
        os.replace(temp, path)

    @property
    def commits(self) -> dict[str, Commit]:
        return {s: Commit(**{**c, "parents": tuple(c["parents"])}) for s, c in self._read("commits").items()}

    @property
    def refs(self) -> dict[str, str]:
        return self._read("refs")

    @property
    def tables(self) -> dict[str, dict]:
        return self._read("tables")

    def _put(self, name: str, key: str, value: object | None) -> None:
        content = self._read(name)
        if value is None:
            content.pop(key, None)
        else:
            content[key] = value
        self._write(name, content)

    # Tables

    def save(self, df: DataFrame, pk: Sequence[str] = (), replace: bool = False) -> str:
        """Stores a table, one row a key, and returns its sum; one that is there already isn't written again.

        Data is written beside its place and moved there whole.
        """
        placed = indexed(ingest.one_per_key(df, pk), pk)
        rows = placed.select(*(F.col(f"`{c}`") for c in df.columns))
        name = ingest.table_sum(rows, pk)
        if replace or name not in self.tables:
            beside = f"{self._path(name)}.{uuid.uuid4().hex}"
            placed.write.parquet(beside)
            self._move(beside, self._path(name))
            self._put("tables", name, {"columns": rows.columns, "pk": list(pk), "rows": placed.count()})
        return name

    def _move(self, beside: str, path: str) -> None:
        """Puts a folder in another's place; what was there goes only when the new one stands."""
        fs, new = self._fs(beside)
        at, old = self._fs(path)[1], self._fs(f"{path}.old-{uuid.uuid4().hex}")[1]
        had = fs.exists(at)
        if had and not fs.rename(at, old):
            raise OSError(f"can't move {path} aside")
        if not fs.rename(new, at):
            if had:
                fs.rename(old, at)
            raise OSError(f"can't move {beside} to {path}")
        if had:
            fs.delete(old, True)

    def _path(self, name: str) -> str:
        return f"{self.data}/tables/{name}"

    def _sum_of(self, name: str) -> str:
        """The table sum that a branch, tag, commit or table sum stands for."""
        found = name if name in self.tables else self.commits[self.resolve(name)].table
        if found not in self.tables:
            raise LookupError(f"table {found} isn't stored here")
        return found

    def table(self, name: str) -> tuple[DataFrame, list[str]]:
        """The rows and key of a branch, tag, commit, or table sum."""
        rows, about = self.stored(name), self.tables[self._sum_of(name)]
        return rows.select(*(F.col(f"`{c}`") for c in about["columns"] if c in rows.columns)), about["pk"]

    def stored(self, name: str) -> DataFrame:
        """A version as it is stored: with row numbers and sums."""
        return self.spark.read.parquet(self._path(self._sum_of(name)))

    def rows_at(self, name: str, offsets: Sequence[int]) -> DataFrame:
        """The rows at positions in key order; files that hold none of them aren't read."""
        return self.stored(name).where(F.col(ROW).isin(list(offsets))).withColumnRenamed(ROW, "row").drop(KEY_SUM, ROW_SUM)

    def blocks(self, name: str, start: int = 0, end: int | None = None) -> DataFrame:
        """The rows of blocks start <= block < end, with row, block and offset."""
        rows = self.stored(name).where(F.col(ROW) >= start * ingest.BLOCK_ROWS)
        if end is not None:
            rows = rows.where(F.col(ROW) < end * ingest.BLOCK_ROWS)
        rows = rows.withColumnRenamed(ROW, "row").drop(KEY_SUM, ROW_SUM)
        return rows.withColumn("block", F.floor(F.col("row") / ingest.BLOCK_ROWS)).withColumn("offset", F.col("row") % ingest.BLOCK_ROWS)

    def block_index(self, name: str) -> DataFrame:
        """block, rows and sum of each block, from the stored sums."""
        rows = self.stored(name).select(F.floor(F.col(ROW) / ingest.BLOCK_ROWS).alias("block"), ROW, ROW_SUM)
        sums = F.transform(F.array_sort(F.collect_list(F.struct(ROW, ROW_SUM))), lambda x: x[ROW_SUM])
        return rows.groupBy("block").agg(F.count("*").alias("rows"), F.md5(F.array_join(sums, "")).alias("sum"))

    def show(self, kind: str, name: str, block: int = 0) -> dict | DataFrame:
        """A stored object: the commit or the table's description as a dict, or one of its blocks as rows."""
        if kind == "commit":
            return {"sum": self.resolve(name), **self._read("commits")[self.resolve(name)]}
        return dict(self.tables[self._sum_of(name)]) if kind == "table" else self.blocks(name, block, block + 1)

    def objects(self, kind: str) -> list[str]:
        """All keys of a kind: commits, tables, profiles, refs or transactions."""
        if kind == "profiles":
            return sorted(t for t in self.tables if self._there(f"{self.data}/profiles/{t}"))
        return sorted(self._read(kind))

    def find_object(self, start: str) -> list[tuple[str, str]]:
        """(kind, sum) of the commits and tables whose sum begins so."""
        return [(kind, s) for kind in ("commits", "tables") for s in self.objects(kind) if s.startswith(start)]

    def profile(self, name: str, refresh: bool = False) -> DataFrame:
        """The profile of a version, made once, or anew if asked for."""
        table = self._sum_of(name)
        path = f"{self.data}/profiles/{table}"
        if refresh or not self._there(path):
            beside = f"{path}.{uuid.uuid4().hex}"
            profile.profile(self.table(table)[0]).write.parquet(beside)
            self._move(beside, path)
        return self.spark.read.parquet(path)

    def profile_ancestors(self, name: str, refresh: bool = True) -> list[str]:
        """Profiles of a version and all its ancestors whose tables are stored here; returns their commits, newest first."""
        done, out = set(), []
        for c in graph.newest_first(self.commits, [self.resolve(name)]):
            if c.table in self.tables:
                out.append(c.sum)
                if c.table not in done:
                    done.add(c.table)
                    self.profile(c.table, refresh)
        return out

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _there(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    # Commits, branches, logs

    def resolve(self, name: str) -> str:
        return graph.resolve(name, self.refs, self.commits)[1]

    def set_ref(self, ref: str, commit: str | None, action: str, message: str = "", transaction: str | None = None) -> None:
        old = self.refs.get(ref)
        self._put("refs", ref, commit)
        entry = {"ref": ref, "old": old, "new": commit, "time": time.time(), "action": action, "message": message, "transaction": transaction}
        with (self.meta / "reflog.jsonl").open("a") as f:
            f.write(json.dumps(entry) + "\n")

    def reflog(self, ref: str) -> list[dict]:
        """Changes of a ref, newest first."""
        path = self.meta / "reflog.jsonl"
        lines = path.read_text().splitlines() if path.exists() else []
        return [e for e in map(json.loads, reversed(lines)) if e["ref"] == ref]

    def has_reflog(self, ref: str) -> bool:
        return bool(self.reflog(ref))

    def reflog_table(self) -> DataFrame:
        """All changes of all refs with their ordinal in their ref, oldest 1."""
        path = self.meta / "reflog.jsonl"
        entries, count, rows = path.read_text().splitlines() if path.exists() else [], {}, []
        for e in map(json.loads, entries):
            count[e["ref"]] = count.get(e["ref"], 0) + 1
            rows.append((e["ref"], count[e["ref"]], e["old"], e["new"], e["action"], e["message"], e["transaction"]))
        return self.spark.createDataFrame(rows, "ref string, ordinal int, old string, new string, action string, message string, transaction string")

    def latest(self) -> DataFrame:
        """(ref, ordinal, new, action): the last change of each ref."""
        return self.reflog_table().groupBy("ref").agg(F.max("ordinal").alias("ordinal"), *(F.max_by(c, "ordinal").alias(c) for c in ("new", "action")))

    def refs_like(self, start: str = "", but_not: str | None = None) -> dict[str, str]:
        """Refs by the beginning of their names."""
        return {r: s for r, s in sorted(self.refs.items()) if r.startswith(start) and (but_not is None or not r.startswith(but_not))}

    def copy_ref(self, old: str, new: str) -> None:
        """A ref under another full name, with its own log."""
        if new in self.refs:
            raise ValueError(f"{new} exists")
        self.set_ref(new, self.refs[old], "copy", f"from {old}")

    def rename_ref(self, old: str, new: str) -> None:
        self.copy_ref(old, new)
        self.set_ref(old, None, "rename", f"to {new}")

    def delete_refs(self, start: str) -> list[str]:
        """Deletes all refs whose full names begin so, such as tags/ or remotes/<name>/."""
        gone = list(self.refs_like(start))
        for ref in gone:
            self.set_ref(ref, None, "delete")
        return gone

    def travel(self, ref: str) -> Iterator[tuple[Commit, dict]]:
        """A ref's own history with the log entry that brought each commit: by parents, and over a merge by what the ref held before.

        It ends where the ref was made, unless it was fetched.
        """
        commits, log = self.commits, self.reflog(ref)
        number, at = 0, log[0]["new"] if log else None
        while at in commits:
            entry = log[number]
            yield commits[at], entry
            parents = commits[at].parents
            if not parents or (entry["old"] is None and entry["action"] != "fetch"):
                return
            at = parents[0] if len(parents) == 1 else entry["old"]
            if number + 1 < len(log) and log[number + 1]["new"] == at:
                number += 1

    def add_commit(self, table: str, parents: Iterable[str], message: str, author: str = "", email: str = "", at: float | None = None, zone: str | None = None) -> str:
        c = {"table": table, "parents": list(parents), "time": time.time() if at is None else at, "author": author, "email": email, "message": message, "zone": zone or time.strftime("%z")}
        name = hashlib.md5(json.dumps(c, sort_keys=True).encode()).hexdigest()
        self._put("commits", name, {"sum": name, **c})
        return name

    def commit(self, branch: str, df: DataFrame, message: str, pk: Sequence[str] = (), author: str = "", email: str = "", if_changed: bool = False) -> str:
        """A new version of a branch, whose head it moves; with ``if_changed``, the head itself if the table is the same."""
        table, head = self.save(df, pk), self.refs.get(f"heads/{branch}")
        if if_changed and head and self.commits[head].table == table:
            return head
        new = self.add_commit(table, [head] if head else [], message, author, email)
        self.set_ref(f"heads/{branch}", new, "commit", message.partition("\n")[0])
        return new

    def configure(self, branch: str, file: str, pk: Sequence[str] = (), delimiter: str = ",") -> None:
        """Names the CSV file that a branch is committed from."""
        self._put("config", branch, {"file": file, "pk": list(pk), "delimiter": delimiter})

    def configured(self, pattern: str | None = None, value: str | None = None) -> dict[str, dict]:
        """Configured branches; those whose file matches a pattern, or is the one given, if either is."""
        matches = lambda f: (pattern is None or re.search(pattern, f) is not None) and value in (None, f)
        return {b: c for b, c in sorted(self._read("config").items()) if matches(c["file"])}

    def scan_file(self, branch: str) -> str:
        """The table of a branch's configured file, read only if its name, time or key are others than at the last scan."""
        about = self._read("config")[branch]
        fs, at = self._fs(about["file"])
        seen = [about["file"], fs.getFileStatus(at).getModificationTime(), about["pk"]]
        cached = self._read("scans").get(branch)
        if cached and cached["seen"] == seen and cached["table"] in self.tables:
            return cached["table"]
        table = self.save(csvio.read_csv(self.spark, about["file"], about["delimiter"]), about["pk"])
        self._put("scans", branch, {"seen": seen, "table": table})
        return table

    def commit_files(self, message: str, branches: Iterable[str] | None = None, author: str = "", email: str = "") -> dict[str, str]:
        """Commits all configured branches whose files changed, or those named; returns their new heads."""
        out = {}
        for branch in branches or self._read("config"):
            table, head = self.scan_file(branch), self.refs.get(f"heads/{branch}")
            if not head or self.commits[head].table != table:
                out[branch] = self.add_commit(table, [head] if head else [], message, author, email)
                self.set_ref(f"heads/{branch}", out[branch], "commit", message.partition("\n")[0])
        return out

    def reapply(self, branch: str, commit: str, message: str | None = None, transaction: str | None = None) -> str:
        """A new commit on a branch with the table of an earlier one; none if the head has that table."""
        old, head = self.commits[self.resolve(commit)], self.refs.get(f"heads/{branch}")
        if old.table not in self.tables:
            raise LookupError("can't reapply a commit whose table isn't stored here")
        if head and self.commits[head].table == old.table:
            return head
        message = message or f"reapply commit {old.sum}\n{old.message}"
        new = self.add_commit(old.table, [head] if head else [], message, old.author, old.email)
        self.set_ref(f"heads/{branch}", new, "reapply", message.partition("\n")[0], transaction)
        return new

    def branches(self, pattern: str = "*") -> list[str]:
        return sorted(r.removeprefix("heads/") for r in self.refs if r.startswith("heads/") and fnmatch(r.removeprefix("heads/"), pattern))

    def create_branch(self, branch: str, start: str) -> None:
        if f"heads/{branch}" in self.refs:
            raise ValueError(f"branch {branch!r} exists")
        self.set_ref(f"heads/{branch}", self.resolve(start), "branch", f"created from {start}")

    def move_branch(self, old: str, new: str) -> None:
        self.create_branch(new, old)
        self.delete_branch(old)

    def delete_branch(self, branch: str) -> None:
        if f"heads/{branch}" not in self.refs:
            raise LookupError(f"no branch {branch!r}")
        self.set_ref(f"heads/{branch}", None, "delete")

    def tag(self, name: str, at: str) -> None:
        self.set_ref(f"tags/{name}", self.resolve(at), "tag")

    def delete_tag(self, name: str) -> None:
        if f"tags/{name}" not in self.refs:
            raise LookupError(f"no tag {name!r}")
        self.set_ref(f"tags/{name}", None, "delete")

    def reset(self, branch: str, to: str) -> None:
        target = self.resolve(to)
        if self.commits[target].table not in self.tables:
            raise LookupError("can't reset to a commit whose table isn't stored here")
        self.set_ref(f"heads/{branch}", target, "reset", f"to {to}")

    def log(self, name: str) -> list[Commit]:
        return list(graph.first_parents(self.commits, self.resolve(name)))

    def history(self, name: str) -> list[tuple[Commit, bool]]:
        """The log with whether each commit's table is stored here."""
        here = set(self.tables)
        return [(c, c.table in here) for c in self.log(name)]

    # Comparing and merging

    def diff(self, new: str, old: str | None = None, **how) -> DataFrame:
        """The row difference of two versions; by default from a version's first parent."""
        (n, pk), (o, old_pk) = self.table(new), self.table(old or f"{new}^")
        if self.resolve(new) == self.resolve(old or f"{new}^"):
            n = n.limit(0)
            o = o.limit(0)
        return rowdiff.row_diff(n, o, pk, old_pk, **how)

    def diff_offsets(self, new: str, old: str) -> DataFrame:
        """(new_row, old_row): where each row that differs stands in either version; null where it has no row."""
        one, other = self.stored(new), self.stored(old)
        (_, pk), (_, old_pk) = self.table(new), self.table(old)
        if pk != old_pk:
            return one.limit(0).select(F.col(ROW).alias("new_row"), F.lit(None).cast("long").alias("old_row"))
        side = lambda d, s: d.select(F.col(ROW).alias(f"{s}_row"), F.col(KEY_SUM).alias(f"{s}_key"), F.col(ROW_SUM).alias(f"{s}_sum"))
        both = side(one, "new").join(side(other, "old"), F.col("new_key") == F.col("old_key"), "full_outer")
        columns = self.tables[self._sum_of(new)]["columns"] == self.tables[self._sum_of(old)]["columns"]
        changed = ~F.col("new_sum").eqNullSafe(F.col("old_sum")) if columns else F.lit(True)
        return both.where(changed).select("new_row", "old_row")

    def plan_merge(self, branch: str, *others: str) -> Merge:
        heads = [self.resolve(x) for x in (branch, *others)]
        base, pk = self.table(graph.merge_base(self.commits, heads))
        sides = [self.table(h) for h in heads]
        if any(key != pk for _, key in sides):
            raise ValueError("versions have different primary keys")
        return merge(base, [df for df, _ in sides], pk)

    def merge(self, branch: str, *others: str, fast_forward: str = "default", resolutions: DataFrame | None = None, merged: DataFrame | None = None, message: str | None = None) -> str:
        """Merges versions into a branch. ``fast_forward``: default, never, or only.

        Every conflict needs one of the ``resolutions``, unless the ``merged`` rows
        are given whole (from a CSV file, say).
        """
        if len(others) > 1 or merged is not None:
            return self._merge_commit(branch, others, resolutions, merged, message)
        other = others[0]
        ours, theirs = self.resolve(branch), self.resolve(other)
        if ours == theirs or graph.is_ancestor(self.commits, theirs, ours):
            return ours
        if graph.is_ancestor(self.commits, ours, theirs) and fast_forward != "never":
            self.set_ref(f"heads/{branch}", theirs, "merge", f"fast-forward to {other}")
            return theirs
        if fast_forward == "only":
            raise ValueError("can't fast-forward")
        return self._merge_commit(branch, others, resolutions, None, message)

    def _merge_commit(self, branch: str, others: Sequence[str], resolutions: DataFrame | None, merged: DataFrame | None, message: str | None) -> str:
        heads = [self.resolve(x) for x in (branch, *others)]
        plan = self.plan_merge(branch, *others)
        if merged is None:
            open_ = plan.conflicts().select(*plan.pk)
            if resolutions is not None:
                open_ = open_.join(resolutions.select(*plan.pk), plan.pk, "left_anti")
            if open_.limit(1).count():
                raise ValueError("versions conflict: see plan_merge(...).conflicts(); each needs a resolution")
            merged = plan.result(resolutions)
        table = self.save(merged, plan.pk)
        names = '", "'.join(others)
        new = self.add_commit(table, heads, message or f'Merge "{names}" into "{branch}"')
        self.set_ref(f"heads/{branch}", new, "merge")
        self.profile(table)
        return new

    # Transactions: versions staged for several branches, which become their heads together

    def begin(self) -> str:
        name = str(uuid.uuid4())
        self._put("transactions", name, {"status": "in-progress", "begin": time.time()})
        return name

    def stage(self, transaction: str, branch: str, df: DataFrame, message: str, pk: Sequence[str] = ()) -> str:
        if self._read("transactions").get(transaction, {}).get("status") != "in-progress":
            raise LookupError("no such transaction in progress")
        head = self.refs.get(f"heads/{branch}")
        new = self.add_commit(self.save(df, pk), [head] if head else [], message)
        self.set_ref(f"txs/{transaction}/{branch}", new, "commit", message)
        return new

    def staged(self, transaction: str) -> dict[str, str]:
        start = f"txs/{transaction}/"
        return {r.removeprefix(start): s for r, s in self.refs.items() if r.startswith(start)}

    def transaction_diff(self, transaction: str) -> dict[str, tuple[str, str | None]]:
        """For each staged branch the new head and the present one."""
        return {b: (s, self.refs.get(f"heads/{b}")) for b, s in self.staged(transaction).items()}

    def finish(self, transaction: str) -> dict[str, str]:
        out = {}
        for branch, s in self.staged(transaction).items():
            c, head = self.commits[s], self.refs.get(f"heads/{branch}")
            message = f"commit [tx/{transaction}]\n{c.message}"
            out[branch] = self.add_commit(c.table, [head] if head else [], message, c.author, c.email)
            self.set_ref(f"heads/{branch}", out[branch], "commit", message.partition("\n")[0], transaction)
        self._drop_staged(transaction)
        self._put("transactions", transaction, {**self._read("transactions")[transaction], "status": "committed", "end": time.time()})
        return out

    def reapply_transaction(self, transaction: str) -> dict[str, str]:
        """Commits once more, on the present heads, what a finished transaction committed."""
        path = self.meta / "reflog.jsonl"
        entries = [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []
        done = [e for e in entries if e["transaction"] == transaction and e["action"] == "commit" and e["ref"].startswith("heads/")]
        if not done:
            raise LookupError("no such finished transaction")
        again = self.begin()
        out = {(b := e["ref"].removeprefix("heads/")): self.reapply(b, e["new"], f"reapply [tx/{transaction}]\n{self.commits[e['new']].message}", again) for e in done}
        self._put("transactions", again, {**self._read("transactions")[again], "status": "committed", "end": time.time()})
        return out

    def push_transaction(self, other: VersionStore, transaction: str) -> dict[str, str]:
        """Sends what is staged to another store, where the transaction goes on under its name."""
        other._put("transactions", transaction, self._read("transactions")[transaction])
        return {b: other._receive(self, f"txs/{transaction}/{b}", s, None, True) for b, s in self.staged(transaction).items()}

    def _drop_staged(self, transaction: str) -> None:
        for branch in self.staged(transaction):
            self.set_ref(f"txs/{transaction}/{branch}", None, "discard")

    def discard(self, transaction: str) -> None:
        self._drop_staged(transaction)
        self._put("transactions", transaction, None)

    def transactions(self, offset: int = 0, limit: int | None = None) -> list[tuple[str, dict]]:
        """Newest first."""
        every = sorted(self._read("transactions").items(), key=lambda t: -t[1]["begin"])
        return every[offset : None if limit is None else offset + limit]

    # Upkeep

    def prune(self) -> dict[str, list[str]]:
        """Deletes commits that no ref leads to, and tables that no commit is left for."""
        gone = graph.unreachable(self.commits, self.refs)
        left = {s: c for s, c in self._read("commits").items() if s not in gone}
        tables = set(self.tables) - {c["table"] for c in left.values()}
        self._write("commits", left)
        self._write("tables", {t: m for t, m in self.tables.items() if t not in tables})
        for t in tables:
            self._delete(self._path(t))
            self._delete(f"{self.data}/profiles/{t}")
        return {"commits": sorted(gone), "tables": sorted(tables)}

    def collect_garbage(self, ttl: float = TRANSACTION_TTL) -> dict[str, list[str]]:
        """Discards transactions begun more than ``ttl`` seconds ago that didn't end, then prunes."""
        for name, t in self.transactions():
            if t["status"] == "in-progress" and t["begin"] <= time.time() - ttl:
                self.discard(name)
        return self.prune()

    def diagnose(self) -> list[Issue]:
        """The first issue of each reachable commit that has one."""
        commits = self.commits
        reached = graph.ancestors(commits, self.refs.values())
        below = {s: graph.ancestors(commits, [s]) - {s} for s in reached}
        out = []
        for s in sorted(reached):
            lost = [p for p in commits[s].parents if p not in commits]
            found = ("a parent is missing", "remove") if lost else self._table_issue(commits[s].table)
            if found:
                out.append(Issue(s, *found, len(below[s]), sum(s in b for b in below.values())))
        return out

    def _table_issue(self, table: str) -> tuple[str, str] | None:
        """(issue, remedy) of a stored table: remove the commit, reset the key, or ingest the rows again."""
        if table not in self.tables:
            return "the table is missing", "remove"
        if not self._there(self._path(table)):
            return "the table's rows are missing", "remove"
        about = self.tables[table]
        try:
            stored = self.spark.read.parquet(self._path(table))
        except AnalysisException:
            return "the table's rows can't be read", "remove"
        if "" in about["pk"]:
            return "a key column has no name", "reset key"
        if missing := [k for k in about["pk"] if k not in about["columns"] or k not in stored.columns]:
            return f"key columns are missing: {', '.join(missing)}", "reset key"
        if missing := [c for c in about["columns"] if c not in stored.columns]:
            return f"columns are missing: {', '.join(missing)}", "remove"
        df = stored.select(*(F.col(f"`{c}`") for c in about["columns"]))
        if ingest.duplicate_keys(df, about["pk"]).limit(1).count():
            return "keys are repeated", "ingest again"
        if (n := df.count()) != about["rows"]:
            return f"rows don't match: {n} instead of {about['rows']}", "ingest again"
        if any(c not in stored.columns for c in (ROW, KEY_SUM, ROW_SUM)):
            return "the index is missing", "ingest again"
        wrong = self.wrong_index(table)
        if wrong:
            return wrong, "ingest again"
        if ingest.table_sum(df, about["pk"]) != table:
            return "rows aren't those of the sum", "ingest again"
        return None

    def wrong_index(self, name: str) -> str | None:
        """What is wrong with a version's stored row numbers and sums, made anew and compared; None if nothing is."""
        stored, (df, pk) = self.stored(name), self.table(name)
        r = stored.agg(
            F.count("*").alias("n"),
            F.count_if(F.col(ROW).isNull() | F.col(ROW_SUM).isNull() | F.col(KEY_SUM).isNull()).alias("empty"),
            F.count_if((F.col(ROW_SUM) != row_sum(df)) | (F.col(KEY_SUM) != row_sum(df, pk or df.columns))).alias("other"),
            F.min(ROW).alias("least"),
            F.max(ROW).alias("most"),
            F.sum(F.col(ROW).cast("decimal(38,0)")).alias("total"),
        ).first()
        if r["empty"]:
            return "index sums are empty"
        if r["other"]:
            return "index sums don't match"
        if r["n"] and (r["least"] != 0 or r["most"] != r["n"] - 1 or r["total"] != r["n"] * (r["n"] - 1) // 2):
            return "row numbers don't match"
        return None

    def reindex(self, name: str) -> None:
        """Makes a version's row numbers and sums anew."""
        table = self._sum_of(name)
        df, pk = self.table(table)
        beside = f"{self._path(table)}.{uuid.uuid4().hex}"
        indexed(df, pk).write.parquet(beside)
        self._move(beside, self._path(table))

    def repair(self) -> list[Issue]:
        """Rewrites history so that no diagnosed issue is left on branches and tags; returns what was found.

        Commits that are removed hand their parents on to their children; merges keep all theirs.
        """
        issues = self.diagnose()
        remedy = {i.commit: i for i in issues}
        if not issues:
            return issues
        commits = self.commits
        reached = graph.ancestors(commits, self.refs.values())
        instead: dict[str, list[str]] = {}
        for s in graph.parents_first(commits, reached):
            c = commits[s]
            parents = list(dict.fromkeys(p for old in c.parents for p in instead.get(old, [])))
            if s in remedy and remedy[s].remedy == "remove" and self._table_issue(c.table) is not None:
                instead[s] = parents
                continue
            table = c.table
            if s in remedy and remedy[s].remedy != "remove":
                df = self.spark.read.parquet(self._path(c.table)).drop(ROW, KEY_SUM, ROW_SUM)
                table = self.save(df, self.tables[c.table]["pk"] if remedy[s].remedy == "ingest again" else (), replace=True)
            same = table == c.table and parents == list(c.parents)
            instead[s] = [s if same else self.add_commit(table, parents, c.message, c.author, c.email, c.time, c.zone)]
        for ref, s in self.refs.items():
            if s in instead and instead[s] != [s]:
                self.set_ref(ref, instead[s][0] if instead[s] else None, "repair")
        return issues

    # Remotes: names of other stores

    def add_remote(self, name: str, url: str) -> None:
        if name in self._read("remotes"):
            raise ValueError(f"remote {name!r} exists")
        self._put("remotes", name, {"url": url, "branches": ["*"]})

    def remote(self, name: str) -> dict:
        if name not in self._read("remotes"):
            raise LookupError(f"no remote {name!r}")
        return self._read("remotes")[name]

    def set_remote(self, name: str, url: str | None = None, branches: Sequence[str] | None = None) -> None:
        """Another place for a remote, or the patterns of the branches that are fetched from it."""
        old = self.remote(name)
        self._put("remotes", name, {"url": url or old["url"], "branches": list(branches) if branches is not None else old["branches"]})

    def rename_remote(self, old: str, new: str) -> None:
        about = self.remote(old)
        if new in self._read("remotes"):
            raise ValueError(f"remote {new!r} exists")
        self._put("remotes", new, about)
        self._put("remotes", old, None)
        for ref in self.refs_like(f"remotes/{old}/"):
            self.rename_ref(ref, f"remotes/{new}/{ref.removeprefix(f'remotes/{old}/')}")

    def remove_remote(self, name: str) -> None:
        self.remote(name)
        self._put("remotes", name, None)
        self.delete_refs(f"remotes/{name}/")

    def open_remote(self, name: str) -> VersionStore:
        return VersionStore(self.spark, self.remote(name)["url"])

    def remotes_with(self, commit: str) -> list[str]:
        """The remotes whose fetched branches lead to a commit."""
        at, found = self.resolve(commit), set()
        for ref, s in self.refs_like("remotes/").items():
            if at in graph.ancestors(self.commits, [s]):
                found.add(ref.split("/")[1])
        return sorted(found)

    # Other stores that this driver and its executors reach

    def fetch(
        self, other: VersionStore, remote: str, branches: Iterable[str] | None = None, depth: int | None = None, force: bool = False, tags: bool = False
    ) -> dict[str, str]:
        """Copies what is missing of another store's branches, and moves remotes/<remote>/<branch>; returns what became of each.

        With ``depth``, tables of older commits stay away until ``fetch_tables``.
        ``tags`` are fetched under their names; one that is here with another
        commit is left, unless forced.
        """
        patterns = self._read("remotes").get(remote, {}).get("branches", ["*"])
        names = list(branches or (b for b in other.branches() if any(fnmatch(b, p) for p in patterns)))
        out = {b: self._receive(other, f"remotes/{remote}/{b}", other.refs[f"heads/{b}"], depth, force) for b in names}
        for ref, s in other.refs_like("tags/").items() if tags else ():
            clobbers = self.refs.get(ref) not in (None, s)
            out[ref] = "would clobber" if clobbers and not force else self._receive(other, ref, s, depth, True)
        return out

    def fetch_tables(self, other: VersionStore, *names: str) -> list[str]:
        """Copies tables of commits that were fetched without them: of the versions named, or of all commits here; returns their sums."""
        wanted = {self.commits[self.resolve(n)].table for n in names} if names else {c.table for c in self.commits.values()}
        missing = sorted(t for t in wanted if t not in self.tables and t in other.tables)
        for t in missing:
            self._copy_table(other, t)
        return missing

    def push(self, other: VersionStore, branch: str, force: bool = False) -> str:
        return other._receive(self, f"heads/{branch}", self.refs[f"heads/{branch}"], None, force)

    def push_delete(self, other: VersionStore, branch: str) -> None:
        """Deletes a branch of the other store."""
        other.delete_branch(branch)

    def pull(self, other: VersionStore, remote: str, branch: str) -> str:
        self.fetch(other, remote, [branch])
        if f"heads/{branch}" not in self.refs:
            self.create_branch(branch, f"remotes/{remote}/{branch}")
            return self.refs[f"heads/{branch}"]
        return self.merge(branch, f"remotes/{remote}/{branch}")

    def _copy_table(self, other: VersionStore, t: str) -> None:
        """Takes over a table beside its place; nothing is kept unless its sum is right."""
        beside = f"{self._path(t)}.{uuid.uuid4().hex}"
        other.stored(t).write.parquet(beside)
        about = other.tables[t]
        copied = self.spark.read.parquet(beside)
        if ingest.table_sum(copied.select(*(F.col(f"`{c}`") for c in about["columns"])), about["pk"]) != t:
            self._delete(beside)
            raise ValueError(f"table {t} arrived changed")
        self._move(beside, self._path(t))
        self._put("tables", t, about)

    def _receive(self, other: VersionStore, ref: str, want: str, depth: int | None, force: bool) -> str:
        theirs, old = other.commits, self.refs.get(ref)
        commits, _ = graph.to_send(theirs, [want], self.commits, depth)
        _, tables = graph.to_send(theirs, [want], [], depth)
        missing = sorted((tables - set(self.tables)) & set(other.tables))  # those of a shallow fetch among them
        for t in missing:
            self._copy_table(other, t)
        if old == want:
            return "tables" if missing else "up to date"
        raw = other._read("commits")
        self._write("commits", {**self._read("commits"), **{c: raw[c] for c in commits}})
        ahead = old is None or old in graph.ancestors(self.commits, [want])
        if not ahead and not force:
            return "rejected"
        self.set_ref(ref, want, "fetch")
        return "new" if old is None else "fast-forward" if ahead else "forced"


def indexed(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """df in key order with its row numbers and sums; without a key, the key's sum is the row's."""
    sums = df.withColumns({KEY_SUM: row_sum(df, pk or df.columns), ROW_SUM: row_sum(df)})
    return ingest.numbered(sums, list(pk) or df.columns, ROW)


def object_sizes(store: VersionStore) -> DataFrame:
    """For each kind of stored object their number and the sizes of their metadata in bytes."""
    rows = [(kind, len(k), len(json.dumps(v))) for kind in ("commits", "refs", "tables") for k, v in store._read(kind).items()]
    df = store.spark.createDataFrame(rows, "kind string, key_size int, value_size int")
    return df.groupBy("kind").agg(
        F.count("*").alias("objects"),
        *(f(c).alias(f"{n}_{c}") for c in ("key_size", "value_size") for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_pop))),
    )
