"""Multi-root recursive inventory scan as a Python Data Source (O-01, O-02).

``spark.read.format("snapplan_inventory").option("roots", "/a;/b")
.option("ignore", "*.tmp;node_modules").load()``

Semantics
  * roots are split on ``,`` or ``;`` and keep their order (``root_ord``);
    overlapping roots may list a path twice;
  * hidden files, ``_``-prefixed files and empty files are listed (unlike
    ``binaryFile``), content is not read;
  * symbolic links are listed as links (``is_symlink``, ``link_target`` =
    absolute immediate target) and never followed, so link loops cannot
    occur;
  * ignore rules prune during the walk: an ignored directory (bare name or
    full path, the root included) is not descended;
  * a missing root or an unreadable directory becomes a row with ``issue``
    set and the scan goes on (split them off with ``scan_issues``).

Parallelism: the driver expands the top of each root breadth-first (a
bounded listing of at most ``max_units`` directories) into independent
work units; each unit is one input partition walked inside a task.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.ignore import NameTest, Rules, name_test

SCHEMA = ("root_ord int, root string, dir string, path string, name string, ext string, "
          "size long, mtime long, is_symlink boolean, link_target string, link_to_dir boolean, issue string")


def _split(v: str | None) -> list[str]:
    if not v:
        return []
    out = []
    for part in v.replace(";", ",").split(","):
        part = part.strip()
        if part:
            out.append(part)
    return out


def _ext_c(name: str) -> str:
    i = name.rfind(".")
    if i < 0 or i == len(name) - 1:
        return ""
    return name[i:]


class _Unit(InputPartition):
    """One work unit: a directory walked recursively, or its files only
    (optionally one hash shard of them: entries whose name hashes to
    ``shard`` of ``shards``)."""

    def __init__(self, root_ord, root, directory, recursive, issue=None, shard=0, shards=1):
        super().__init__(None)
        self.root_ord, self.root, self.directory = root_ord, root, directory
        self.recursive, self.issue = recursive, issue
        self.shard, self.shards = shard, shards


def _in_shard(name: str, u: "_Unit") -> bool:
    if u.shards <= 1:
        return True
    import zlib
    return zlib.crc32(name.encode("utf-8", "surrogateescape")) % u.shards == u.shard


def _file_row(u: _Unit, d: str, entry: os.DirEntry) -> tuple:
    name = entry.name
    path = os.path.join(d, name)
    is_link = entry.is_symlink()
    target = None
    to_dir = False
    if is_link:
        to_dir = os.path.isdir(path)
        try:
            t = os.readlink(path)
            target = os.path.normpath(os.path.join(d, t))
        except OSError:
            target = None
        try:
            st = os.stat(path)
        except OSError:
            st = os.lstat(path)
    else:
        st = entry.stat(follow_symlinks=False)
    return (u.root_ord, u.root, d, path, name, _ext_c(name), int(st.st_size),
            int(st.st_mtime_ns // 1000), is_link, target, to_dir, None)


def _issue_row(u: _Unit, d: str, reason: str) -> tuple:
    return (u.root_ord, u.root, d, d, os.path.basename(d), "", None, None, None, None, None, reason)


def _readable(text: str) -> str:
    """A name as valid text: bytes that are not UTF-8 as escapes."""
    return os.fsencode(text).decode("utf-8", "backslashreplace")


def _walk(u: _Unit, m: NameTest) -> Iterator[tuple]:
    """Rows of a unit, one entry at a time.  What cannot be listed, has gone
    meanwhile or has a name that is no text becomes an issue row."""
    if u.issue:
        yield _issue_row(u, u.directory, u.issue)
        return
    stack = [u.directory]
    while stack:
        d = stack.pop()
        top = d == u.directory
        try:
            with os.scandir(d) as entries:
                for e in entries:
                    if top and not _in_shard(e.name, u):
                        continue
                    full = os.path.join(d, e.name)
                    if _readable(full) != full:
                        yield _issue_row(u, _readable(full), "name is not UTF-8")
                        continue
                    try:
                        if e.is_dir(follow_symlinks=False):
                            if u.recursive and not m(e.name, full):
                                stack.append(full)
                            continue
                        row = None if m(e.name, full) else _file_row(u, d, e)
                    except OSError as gone:
                        row = _issue_row(u, full, f"error: {gone.strerror}")
                    if row:
                        yield row
        except PermissionError as e:
            yield _issue_row(u, d, f"unreadable: {e.strerror}")
        except OSError as e:
            yield _issue_row(u, d, f"error: {e.strerror}")


class InventoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = (json.loads(options["roots_json"]) if options.get("roots_json")
                      else _split(options.get("roots")))
        self.patterns = [p for p in (json.loads(options["ignore_json"]) if options.get("ignore_json")
                                     else _split(options.get("ignore"))) if p and p.strip()]
        self.max_units = int(options.get("max_units", "256"))
        self.split_entries = int(options.get("split_entries", "50000"))

    def partitions(self):
        m = name_test(Rules.of(self.patterns))
        units: list[_Unit] = []
        for i, root in enumerate(self.roots):
            r = os.path.abspath(root)
            if not os.path.isdir(r):
                units.append(_Unit(i, root, r, False, "missing root"))
                continue
            if m(os.path.basename(r), r):
                continue
            units.extend(self._expand(i, root, r, m))
        return units or [_Unit(0, "", "", False, "no roots")]

    def _expand(self, i: int, root: str, r: str, m: NameTest) -> list[_Unit]:
        """Breadth-first split of a root into at most ``max_units`` work
        units.  An expanded directory contributes its files (in hash shards
        when there are many) and its sub-directories; one that would pass
        the bound, or has more entries than the driver lists, is walked by
        the units that are left, each taking a hash shard of its entries."""
        frontier, done = [r], []
        while frontier and len(done) + len(frontier) < self.max_units:
            d = frontier.pop(0)
            left = self.max_units - len(done) - len(frontier)
            subs, n = [], 0
            try:
                with os.scandir(d) as it:
                    for e in it:
                        n += 1
                        full = os.path.join(d, e.name)
                        if e.is_dir(follow_symlinks=False) and not m(e.name, full):
                            subs.append(full)
                        if len(subs) > left or n > left * self.split_entries:
                            break
            except OSError:
                done.append(_Unit(i, root, d, True))        # the task reports the issue
                continue
            k = max(1, -(-n // self.split_entries))
            if k + len(subs) > left:
                done.extend(_Unit(i, root, d, True, shard=j, shards=left) for j in range(left))
                continue
            done.extend(_Unit(i, root, d, False, shard=j, shards=k) for j in range(k))
            frontier.extend(sorted(subs))
        done.extend(_Unit(i, root, d, True) for d in frontier)
        return done

    def read(self, partition: _Unit):
        if partition.issue == "no roots":
            return iter(())
        return _walk(partition, name_test(Rules.of(self.patterns)))


class InventorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapplan_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return InventoryReader(self.options)


def register(spark: SparkSession) -> None:
    from ..session import ship_package
    ship_package(spark)
    spark.dataSource.register(InventorySource)


def inventory(spark: SparkSession, roots: list[str] | str, ignore: list[str] | None = None,
              max_units: int | None = None, split_entries: int = 50_000) -> DataFrame:
    """O-01 + O-02: every row of the scan, issues included.  ``max_units``
    defaults to four work units per core of the cluster."""
    register(spark)
    if max_units is None:
        max_units = max(8, 4 * spark.sparkContext.defaultParallelism)
    root_list = _split(roots) if isinstance(roots, str) else list(roots)
    return (spark.read.format("snapplan_inventory").option("roots_json", json.dumps(root_list))
            .option("ignore_json", json.dumps(list(ignore or [])))
            .option("max_units", str(max_units)).option("split_entries", str(split_entries)).load())


def files_only(scan: DataFrame) -> DataFrame:
    return scan.filter(F.col("issue").isNull()).drop("issue")


def scan_issues(scan: DataFrame) -> DataFrame:
    return scan.filter(F.col("issue").isNotNull()).select("root_ord", "root", "path", "issue")
