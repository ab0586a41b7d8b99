"""Snapshots: capture, listing, query, statistics, diff, lineage, restore plans, deletion."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.numbering import largest, numbered
from ..repository import Repository


@dataclass(frozen=True)
class SnapshotQuery:
    """All given conditions must hold. A null size or time passes its range."""

    exact: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    glob: str | None = None
    regex: str | None = None
    least_size: int | None = None
    most_size: int | None = None
    after: int | None = None
    before: int | None = None

    def __post_init__(self):
        if any(not p.endswith("/") for p in self.prefixes):
            raise ValueError("a prefix must end with /")
        for a, b in ((self.least_size, self.most_size), (self.after, self.before)):
            if a is not None and b is not None and a > b:
                raise ValueError("a range must not be reversed")
        if self.glob is not None:
            scalars.glob_regex(self.glob)
        if self.regex is not None:
            scalars.safe_regex(self.regex)

    @classmethod
    def of(cls, after: str | None = None, before: str | None = None, **options) -> SnapshotQuery:
        """A query with its time bounds as a user writes them: RFC 3339 times or dates."""
        bound = lambda v, upper: None if v is None else scalars.parse_bound(v, upper)
        return cls(after=bound(after, False), before=bound(before, True), **options)

    def condition(self, path: Column, size: Column, mtime: Column) -> Column:
        out = F.lit(True)
        if self.exact:
            out &= path.isin(*self.exact)
        if self.prefixes:
            some = F.lit(False)
            for p in self.prefixes:
                some |= path.startswith(p)
            out &= some
        if self.glob is not None:
            out &= scalars.matches_glob(path, self.glob)
        if self.regex is not None:
            out &= path.rlike(scalars.safe_regex(self.regex))
        for c, low, high in ((size, self.least_size, self.most_size), (mtime, self.after, self.before)):
            if low is not None:
                out &= c.isNull() | (c >= low)
            if high is not None:
                out &= c.isNull() | (c <= high)
        return out


def listed(repo: Repository, kind: str | None = None, label: str | None = None, since: int | None = None, until: int | None = None, limit: int = 0) -> DataFrame:
    """Newest first; a limit of 0 is none; a null label never matches."""
    s = repo.snapshot
    if kind is not None:
        s = s.where(F.col("type") == kind)
    if label is not None:
        s = s.where(F.lower("label").like(f"%{label.lower()}%"))
    if since is not None:
        s = s.where(F.col("created_at") >= since)
    if until is not None:
        s = s.where(F.col("created_at") <= until)
    s = s.orderBy(F.desc("created_at"), F.desc("id"))
    return s.limit(limit) if limit else s


def entries(repo: Repository, snapshot_id: str) -> DataFrame:
    f = repo.snapshot_file.where(F.col("snapshot_id") == snapshot_id)
    return f.join(repo.snapshot_path.withColumnRenamed("id", "path_id"), "path_id").select(scalars.normalized_path(F.col("path")).alias("path"), "logical_file_id", "size", "mode", "mtime")


def show(repo: Repository, snapshot_id: str, query: SnapshotQuery = SnapshotQuery(), limit: int = 0) -> DataFrame:
    e = matching(repo, snapshot_id, query).orderBy("path", "logical_file_id")
    return e.limit(limit) if limit else e


def matching(repo: Repository, snapshot_id: str, query: SnapshotQuery = SnapshotQuery()) -> DataFrame:
    """The entries that a query asks for, in no order."""
    return entries(repo, snapshot_id).where(query.condition(F.col("path"), F.col("size"), F.col("mtime")))


def path_ids(repo: Repository, paths: DataFrame) -> DataFrame:
    """path and id of each given path (a column `path`), normalized; null where the dictionary doesn't have it."""
    wanted = paths.select(scalars.normalized_path(F.col("path")).alias("path")).distinct()
    return wanted.join(repo.snapshot_path.select("path", "id"), "path", "left")


def path_id(repo: Repository, path: str) -> int | None:
    """The id of one path."""
    row = path_ids(repo, repo.spark.createDataFrame([(path,)], "path string")).head()
    return row["id"] if row else None


def totals(repo: Repository) -> DataFrame:
    one = repo.snapshot.agg(F.count(F.lit(1)).alias("snapshots"))
    return one.crossJoin(repo.snapshot_file.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")))


def lineage(repo: Repository) -> DataFrame:
    """Files, bytes and what is shared with the parent, for every snapshot."""
    f = repo.snapshot_file
    own = f.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    s = repo.snapshot
    links = s.select(F.col("id").alias("child"), "parent_id").join(s.select(F.col("id").alias("parent_id"), F.col("type").alias("parent_type")), "parent_id")
    kids = F.broadcast(links).join(f, F.col("child") == F.col("snapshot_id")).select("child", "parent_id", "path_id", "logical_file_id")
    older = f.select(F.col("snapshot_id").alias("parent_id"), "path_id", "logical_file_id")
    reused = kids.join(older, ["parent_id", "path_id", "logical_file_id"], "left_semi").groupBy("child").agg(F.count(F.lit(1)).alias("reused"))
    out = s.join(own, s["id"] == own["snapshot_id"], "left").join(links.select("child", "parent_type"), F.col("id") == F.col("child"), "left").join(reused.withColumnRenamed("child", "kid"), F.col("id") == F.col("kid"), "left")
    state = F.when(F.col("parent_id").isNull(), "no_parent").when(F.col("type") == "partial", "lineage_skipped").when(F.col("parent_type").isNull(), "parent_missing").when(F.col("parent_type") != "full", "lineage_skipped").otherwise("lineage_computed")
    shared = F.when(state == "lineage_computed", F.coalesce("reused", F.lit(0)))
    return out.select("id", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), state.alias("lineage"), shared.alias("reused"), F.round(scalars.ratio(shared, F.col("files")), 6).alias("reuse_ratio"))


def diff(repo: Repository, base: str, target: str, query: SnapshotQuery = SnapshotQuery(), kind: str | None = None) -> DataFrame:
    """Added, removed and modified paths. Classified first, filtered second, by the target's data but for removed ones.
    Identity is the path and the logical file alone. A path with several files in a snapshot is an error."""
    out = _changes(repo, base, target).where("change IS NOT NULL")
    gone = F.col("change") == "removed"
    out = out.where(query.condition(F.col("path"), F.when(gone, F.col("b_size")).otherwise(F.col("t_size")), F.when(gone, F.col("b_mtime")).otherwise(F.col("t_mtime"))))
    if kind is not None:
        out = out.where(F.col("change") == kind)
    return out.select("path", "change", F.col("b_logical_file_id").alias("base_file"), F.col("t_logical_file_id").alias("target_file")).orderBy("path")


def _changes(repo: Repository, base: str, target: str) -> DataFrame:
    def side(name: str, p: str) -> DataFrame:
        own = entries(repo, name).groupBy("path").agg(F.countDistinct("logical_file_id").alias("n"), F.min("logical_file_id").alias("file"), F.min("size").alias(p + "size"), F.min("mtime").alias(p + "mtime"))
        clash = F.raise_error(F.concat(F.lit(f"snapshot {name} has several files at "), "path")).cast("long")
        return own.select("path", F.when(F.col("n") > 1, clash).otherwise(F.col("file")).alias(p + "logical_file_id"), p + "size", p + "mtime")

    b, t = F.col("b_logical_file_id"), F.col("t_logical_file_id")
    change = F.when(b.isNull(), "added").when(t.isNull(), "removed").when(b != t, "modified")
    return side(base, "b_").join(side(target, "t_"), "path", "full").withColumn("change", change)


def diff_counts(repo: Repository, base: str, target: str, query: SnapshotQuery = SnapshotQuery(), kind: str | None = None) -> DataFrame:
    """How many changes there are and how many of them a query and a kind match."""
    total = _changes(repo, base, target).agg(F.count("change").alias("total"))
    return diff(repo, base, target, query, kind).agg(F.count(F.lit(1)).alias("matched")).crossJoin(total)


def conflicts(repo: Repository, snapshot_id: str) -> DataFrame:
    """Normalized paths of a snapshot with several logical files: a diff can't use them."""
    return entries(repo, snapshot_id).groupBy("path").agg(F.countDistinct("logical_file_id").alias("files")).where("files > 1")


def diff_summary(repo: Repository, base: str, target: str) -> DataFrame:
    """The counts, by path id."""
    f = repo.snapshot_file.where(F.col("snapshot_id").isin(base, target))
    side = lambda s: F.max(F.when(F.col("snapshot_id") == s, F.col("logical_file_id")))
    g = f.groupBy("path_id").agg(side(base).alias("b"), side(target).alias("t"))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return g.agg(n("b IS NULL").alias("added"), n("t IS NULL").alias("removed"), n("b <> t").alias("modified"))


def unique_to(repo: Repository, snapshot_id: str) -> DataFrame:
    f = repo.snapshot_file
    own = f.where(F.col("snapshot_id") == snapshot_id)
    return own.join(f.where(F.col("snapshot_id") != snapshot_id).select("path_id", "logical_file_id"), ["path_id", "logical_file_id"], "left_anti")


def delete_preview(repo: Repository, snapshot_id: str) -> DataFrame:
    own = repo.snapshot_file.where(F.col("snapshot_id") == snapshot_id).agg(F.count(F.lit(1)).alias("total"))
    alone = unique_to(repo, snapshot_id).agg(F.count(F.lit(1)).alias("unique_files"))
    kids = repo.snapshot.where(F.col("parent_id") == snapshot_id).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("children"))
    return own.crossJoin(alone).crossJoin(kids).select("total", "unique_files", (F.col("total") - F.col("unique_files")).alias("shared_files"), "children")


def tree(repo: Repository) -> DataFrame:
    """id, depth and place of every snapshot, depth first; a snapshot without a known parent is a root; members of cycles become
    roots at the end. Snapshots are few (one for each capture), so their ids are put in order on the driver."""
    rows = sorted((r["created_at"], r["id"], r["parent_id"]) for r in repo.snapshot.select("id", "created_at", "parent_id").collect())
    ids, out, seen = {r[1] for r in rows}, [], set()
    kids: dict[str, list[str]] = {}
    for _, i, parent in rows:
        kids.setdefault(parent, []).append(i)
    for _, root, _ in [r for r in rows if r[2] is None or r[2] not in ids] + rows:
        stack = [(root, 0)]
        while stack:
            x, d = stack.pop()
            if x not in seen:
                seen.add(x)
                out.append((x, d, len(out)))
                stack += [(k, d + 1) for k in reversed(kids.get(x, []))]
    return repo.spark.createDataFrame(out, "id string, depth long, place long")


def wanted_paths(paths: tuple[str, ...]) -> tuple[str, ...]:
    """Given paths, normalized, each once, in order; an invalid one is an error."""
    out = []
    for p in paths:
        q = re.sub("/{2,}", "/", re.sub(r"^(?:\./+)+", "", p.replace("\\", "/")))
        if not q or p != p.strip() or p[0] in "/\\":
            raise ValueError(f"not a snapshot path: {p!r}")
        if q not in out:
            out.append(q)
    return tuple(out)


def selected_source(repo: Repository, paths: tuple[str, ...] = ()) -> DataFrame:
    """Current files as snapshot rows: normalized, the first of equal paths, all or those that paths name ('/' at the end: a folder)."""
    src = repo.physical_file.join(repo.logical_file.select(F.col("id").alias("logical_file_id"), "total_size"), "logical_file_id")
    src = src.withColumn("key", scalars.source_path(F.col("path"))).where("key IS NOT NULL")
    first = Window.partitionBy("key").orderBy("path", "logical_file_id")
    src = src.withColumn("n", F.row_number().over(first)).where("n = 1")
    if paths:
        paths = wanted_paths(paths)
        exact, folders = tuple(p for p in paths if not p.endswith("/")), tuple(p for p in paths if p.endswith("/"))
        some = F.lit(False)
        if exact:
            some |= F.col("key").isin(*exact)
        for p in folders:
            some |= F.col("key").startswith(p)
        src = src.where(some)
        if exact:
            there = {r["key"] for r in src.where(F.col("key").isin(*exact)).select("key").collect()}  # at most the given paths
            if missing := sorted(set(exact) - there):
                raise ValueError(f"no such path: {missing[0]}")
    return src.select(F.col("key").alias("path"), "logical_file_id", F.col("total_size").alias("size"), "mode", "mtime")


def create(repo: Repository, snapshot_id: str, created_at: int, paths: tuple[str, ...] = (), label: str | None = None, parent: str | None = None) -> Repository:
    """A snapshot of the current files, all (full) or those that paths name (partial). Only a full one may have a parent, which
    must be full too. New paths get the ids after the largest one."""
    if not snapshot_id.strip():
        raise ValueError("a snapshot needs an id")
    known = {r["id"]: r["type"] for r in repo.snapshot.select("id", "type").where(F.col("id").isin(snapshot_id, parent or snapshot_id)).collect()}
    if parent == snapshot_id:
        raise ValueError("a snapshot can't be its own parent")
    if snapshot_id in known:
        raise ValueError(f"snapshot {snapshot_id} exists")
    if parent is not None and paths:
        raise ValueError("only a full snapshot may have a parent")
    if parent is not None and known.get(parent) != "full":
        raise ValueError("the parent must be a full snapshot")
    rows = selected_source(repo, paths)
    ids = repo.snapshot_path
    new = rows.join(ids, "path", "left_anti").select("path").distinct()
    dictionary = ids.unionByName(numbered(new, ["path"], largest(ids)).select("id", "path"))
    files = rows.join(dictionary, "path").select(F.lit(snapshot_id).alias("snapshot_id"), F.col("id").alias("path_id"), "logical_file_id", "size", "mode", "mtime")
    return inserted(repo.replace(snapshot_path=dictionary), (snapshot_id, created_at, "partial" if paths else "full", label, parent), files)


def inserted(repo: Repository, row: tuple[str, int, str, str | None, str | None], files: DataFrame) -> Repository:
    """A snapshot's row and its files as they are: an id, a time and a known type are asked for, and of the files ids above 0."""
    if not row[0].strip() or row[1] is None or row[2] not in ("full", "partial"):
        raise ValueError("a snapshot has an id, a time and the type full or partial")
    bad = F.col("path_id").isNull() | (F.col("path_id") <= 0) | F.col("logical_file_id").isNull() | (F.col("logical_file_id") <= 0)
    checked = files.withColumn("path_id", F.when(bad, F.raise_error(F.lit("a snapshot's file has no path or logical file")).cast("long")).otherwise(F.col("path_id")))
    one = repo.spark.createDataFrame([row], repo.snapshot.schema)
    return repo.replace(snapshot=repo.snapshot.unionByName(one), snapshot_file=repo.snapshot_file.unionByName(checked.select(*repo.snapshot_file.columns)))


def delete(repo: Repository, snapshot_id: str) -> Repository:
    """Metadata only; children lose their parent."""
    s = repo.snapshot.where(F.col("id") != snapshot_id).withColumn("parent_id", F.when(F.col("parent_id") != snapshot_id, F.col("parent_id")))
    return repo.replace(snapshot=s, snapshot_file=repo.snapshot_file.where(F.col("snapshot_id") != snapshot_id))


def restore_plan(repo: Repository, snapshot_id: str, mode: str = "original", to: str = "", query: SnapshotQuery = SnapshotQuery()) -> DataFrame:
    """path, logical_file_id, output and collision of what a restore would write."""
    if mode == "override" and (len(query.exact) != 1 or query.prefixes or query.glob or query.regex):
        raise ValueError("override goes with one exact path")
    e = matching(repo, snapshot_id, query).withColumn("output", scalars.restore_target(F.col("path"), mode, to))
    many = e.groupBy("output").agg(F.count(F.lit(1)).alias("n"))
    return e.join(many, "output").select("path", "logical_file_id", "output", (F.col("n") > 1).alias("collision"))


def restore(repo: Repository, snapshot_id: str, mode: str = "original", to: str = "", query: SnapshotQuery = SnapshotQuery(), key: bytes | None = None, overwrite: bool = False) -> DataFrame:
    """Write a snapshot's files where the plan says; path, output and verdict of each. A collision is an error."""
    from .restore import restore as write

    plan = restore_plan(repo, snapshot_id, mode, to, query)
    if not plan.where("collision").isEmpty():
        raise ValueError("several files would be restored to one output")
    return write(repo, plan.select("path", "logical_file_id", "output"), key, overwrite)
