"""The inventory scan in rounds, for trees of any shape (O-01, O-02).

A round is one job over a written frontier: rows of directories still to be
listed.  A task walks its directories depth first until it has seen a given
number of entries and hands the rest to the next round, where everything that
is left is dealt out anew over all tasks.  So a deep, one-sided tree keeps no
task busy while others wait, a small tree needs one round, and neither the
driver nor a task holds more than its share.  A directory with very many
entries is listed once and becomes several rows, each with some of its names;
a round has as many tasks as the names that wait need, so a wide tree needs no
more rounds than a narrow one.

Links to directories are descended under their own path when
``follow_links`` is set (variant C); one that leads to a directory it lies in
is an issue row, told by device and inode of the directories above it.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ignore import NameTest, Rules, name_test
from ..session import shared_path, ship_package
from .inventory import SCHEMA, _file_row, _issue_row, _readable, _Unit

#: entries a task looks at in one round, and entries of a directory above which it is cut
BUDGET, SPLIT = 200_000, 50_000
#: tasks of one round at most; entries and names that a task holds before it hands them on
MOST_TASKS, HELD = 20_000, 50_000

#: a directory to be listed, or some names of one that was; ``above`` names the directories on its way by device and inode
FRONTIER = "root_ord int, root string, dir string, names array<binary>, above array<string>"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: rows of a round: found entries and issues, or (``is_open``) directories for the next one
ROUND = SCHEMA + ", names array<binary>, above array<string>, is_open boolean"


def _identity(path: str) -> str:
    st = os.stat(path)
    return f"{st.st_dev}:{st.st_ino}"


class _Named:
    """An entry known by name, with what the walk asks of an ``os.DirEntry``."""

    def __init__(self, directory: str, name: bytes):
        self.name = os.fsdecode(name)
        self.path = os.path.join(directory, self.name)

    def stat(self, follow_symlinks: bool = True) -> os.stat_result:
        return os.stat(self.path, follow_symlinks=follow_symlinks)

    def is_dir(self, follow_symlinks: bool = True) -> bool:
        try:
            return stat.S_ISDIR(self.stat(follow_symlinks=follow_symlinks).st_mode)
        except FileNotFoundError:
            return False

    def is_symlink(self) -> bool:
        return os.path.islink(self.path)


class _Walk:
    """Rows of the directories one task was given, until its budget is used."""

    def __init__(self, test: NameTest, follow_links: bool, budget: int, split: int):
        self.test, self.follow, self.left, self.split = test, follow_links, budget, split

    def rows(self, given: dict) -> Iterator[tuple]:
        stack = [(given["dir"], given["names"], list(given["above"]))]
        unit = _Unit(given["root_ord"], given["root"], given["dir"], True)
        while stack:
            d, names, above = stack.pop()
            if self.left <= 0:
                yield self._open(unit, d, names, above)
                continue
            try:
                here = _identity(d)
                if here in above:
                    yield (*_issue_row(unit, d, "directory loop"), None, None, False)
                    continue
                found = [_Named(d, n) for n in names or ()]
                if names is None:
                    with os.scandir(d) as entries:
                        for e in entries:
                            found.append(e)
                            if len(found) > self.split:
                                yield from self._cut(unit, d, found, entries, above)
                                found = []
                                break
                for e in found:
                    yield from self._entry(unit, d, e, [*above, here], stack)
            except PermissionError as e:
                yield (*_issue_row(unit, d, f"unreadable: {e.strerror}"), None, None, False)
            except OSError as e:
                yield (*_issue_row(unit, d, f"error: {e.strerror}"), None, None, False)

    def _cut(self, unit: _Unit, d: str, found: list, entries: Iterator[os.DirEntry], above: list) -> Iterator[tuple]:
        """A large directory as rows of at most ``split`` names: those found so far and those still to come."""
        names = [os.fsencode(e.name) for e in found]
        while names:
            self.left -= len(names[:self.split])
            yield self._open(unit, d, names[:self.split], above)
            names = names[self.split:]
            for e in entries:
                names.append(os.fsencode(e.name))
                if len(names) >= self.split:
                    break

    def _entry(self, unit: _Unit, d: str, e: os.DirEntry | _Named, above: list, stack: list):
        self.left -= 1
        full = os.path.join(d, e.name)
        if _readable(full) != full:
            yield (*_issue_row(unit, _readable(full), "name is not UTF-8"), None, None, False)
            return
        if self.test(e.name, full):
            return
        try:
            if e.is_dir(follow_symlinks=self.follow):
                stack.append((full, None, above))
            else:
                yield (*_file_row(unit, d, e), None, None, False)
        except OSError as gone:
            yield (*_issue_row(unit, full, f"error: {gone.strerror}"), None, None, False)

    def _open(self, unit: _Unit, d: str, names: list[bytes] | None, above: list) -> tuple:
        return (unit.root_ord, unit.root, d, d, *([None] * (len(_COLUMNS) - 4)), names, above, True)


def inventory_rounds(spark: SparkSession, roots: Sequence[str], ignore: Sequence[str] = (), follow_links: bool = True,
                     tasks: int | None = None, budget: int = BUDGET, split: int = SPLIT, work: str | None = None) -> DataFrame:
    """Every row of the scan, issues included, in the form of ``inventory``.

    Written below ``work`` (a fresh shared folder by default), one folder per
    round.  Roots that are missing are issue rows, ignored ones give nothing.
    """
    ship_package(spark)
    work = (work or shared_path(spark, "inventory")).rstrip("/")
    tasks = tasks or max(8, 4 * spark.sparkContext.defaultParallelism)
    test = name_test(Rules.of(ignore))
    begin, missing = [], []
    for i, root in enumerate(roots):
        r = os.path.abspath(root)
        if not os.path.isdir(r):
            missing.append((*_issue_row(_Unit(i, root, r, False), r, "missing root"), None, None, False))
        elif not test(os.path.basename(r), r):
            begin.append((i, root, r, None, []))
    spark.createDataFrame(missing, ROUND).write.parquet(f"{work}/round=0")
    frontier, n, patterns = spark.createDataFrame(begin, FRONTIER), len(begin), list(ignore)
    schema = spark.createDataFrame([], ROUND).schema
    arrow = pa.schema([("root_ord", pa.int32()), ("root", pa.string()), ("dir", pa.string()), ("path", pa.string()),
                       ("name", pa.string()), ("ext", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()),
                       ("is_symlink", pa.bool_()), ("link_target", pa.string()), ("link_to_dir", pa.bool_()),
                       ("issue", pa.string()), ("names", pa.list_(pa.binary())),
                       ("above", pa.list_(pa.string())), ("is_open", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, held, n_held = _Walk(name_test(Rules.of(patterns)), follow_links, budget, split), [], 0
        at = arrow.names.index("names")
        for batch in batches:
            for given in batch.to_pylist():
                for row in walk.rows(given):
                    held.append(row)
                    n_held += 1 + len(row[at] or ())
                    if len(held) >= 10_000 or n_held >= HELD:
                        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in held], arrow)
                        held, n_held = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in held], arrow)

    k, named = 0, 0
    while n:
        k += 1
        # what is left is dealt out anew, to enough tasks for the names that wait; directories may hold any number
        parts = min(MOST_TASKS, max(1, min(tasks, n), -(-named // budget)))
        frontier.repartition(parts).mapInArrow(run, schema).write.parquet(f"{work}/round={k}")
        found = spark.read.schema(schema).parquet(f"{work}/round={k}")
        frontier = found.filter("is_open").select("root_ord", "root", "dir", "names", "above")
        n, named = frontier.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.lit(0), F.size("names"))), F.lit(0))).first()
    return spark.read.schema(schema).parquet(work).filter("not is_open").select(*_COLUMNS)
