"""S1 ``scan_trees``: list many source trees into ``raw_files``.

The folder given to ``scan_trees`` holds one tree per sub-folder; the tree's
folder name is its ``repo_id``. A Python Data Source lists the units. The unit of work is one top-level entry of one tree (the tree's
root files form their own unit), so a large monorepo is read by many tasks;
units are dealt into a bounded number of input partitions so small trees
share tasks. Ignored directories are pruned while walking (the listing never
descends into ``node_modules`` and the like), and only ``.py`` text is read,
as the parse is the only consumer of content.

``file_seq`` keeps the walk order of the tree: root files first, then the
top-level directories in listing order, each walked top-down; the top-level
position sits in the high bits, the position inside the partition in the low.

``binaryFile`` is not used: it hides names that start with ``_`` or ``.``
(``__init__.py``, ``.env``), which several rules depend on.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeline.functions import constants as K

SCHEMA = ("repo_id string, file_seq bigint, relative_path string, size bigint, content string, "
          "text_ok boolean")
_SUFFIX = re.compile(r"^.+\.[^.]+$")
_LOCAL_BITS = 40


def _glob(patterns):
    return re.compile("^(?:" + "|".join(p.replace(".", r"\.").replace("*", ".*")
                                          for p in patterns) + ")$")


_FILE_PATTERNS = _glob(K.IGNORE_FILE_PATTERNS)
_DIR_GLOBS = _glob(K.IGNORE_DIR_GLOBS)
_DIR_NAMES = sorted({n.lower() for n in K.IGNORE_DIR_NAMES})
_ARTIFACTS = set(K.ARTIFACT_DIRS)


def _dir_hit(seg: str) -> bool:
    low = seg.lower()
    return seg in _ARTIFACTS or any(n in low for n in _DIR_NAMES) or bool(_DIR_GLOBS.match(seg))


def ignored(rel_parts: list[str]) -> bool:
    """Scan rule F1 on a relative path given as segments (same rule as the Column form)."""
    for seg in rel_parts[:-1]:
        if _dir_hit(seg) or (_SUFFIX.match(seg) and _FILE_PATTERNS.match(seg)):
            return True
    last = rel_parts[-1]
    return bool(_FILE_PATTERNS.match(last)) if _SUFFIX.match(last) else _dir_hit(last)


@dataclass
class TreeUnit:
    repo_id: str
    tree_root: str
    entry: str | None   # None: the files at the tree's root
    position: int


def _directories(tree: str) -> list[str]:
    """Names of the real top-level directories (links are not followed); [] if unreadable."""
    try:
        with os.scandir(tree) as entries:
            return sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
    except OSError:
        return []


def _root_files(tree: str) -> list[str]:
    """Names at the root that are no directory, dangling links included."""
    try:
        with os.scandir(tree) as entries:
            return sorted(e.name for e in entries if not e.is_dir())
    except OSError:
        return []


class TreeWalker:
    """Rows of one unit. A file that cannot be read keeps its row, without content."""

    def __init__(self, read_content: str):
        self.read_content = read_content

    def _row(self, p: TreeUnit, rel: str, full: str, seq: int):
        content, text_ok, size = None, None, 0
        try:
            size = os.path.getsize(full)
            if self.read_content == "all" or (self.read_content == "py" and rel.endswith(".py")):
                with open(full, "rb") as fh:
                    data = fh.read()
                try:
                    content, text_ok = data.decode("utf-8"), True
                except UnicodeDecodeError:
                    content, text_ok = data.decode("utf-8", errors="ignore"), False
                # text mode: every line end is a line feed
                content = content.replace("\r\n", "\n").replace("\r", "\n")
        except OSError:
            pass
        return (p.repo_id, (p.position << _LOCAL_BITS) + seq, rel, size, content, text_ok)

    def walk(self, p: TreeUnit):
        seq = 0
        if p.entry is None:
            for name in _root_files(p.tree_root):
                if not ignored([name]):
                    yield self._row(p, name, os.path.join(p.tree_root, name), seq)
                    seq += 1
            return
        for root, dirs, files in os.walk(os.path.join(p.tree_root, p.entry)):
            rel_root = os.path.relpath(root, p.tree_root).replace(os.sep, "/")
            base = rel_root.split("/")
            dirs[:] = sorted(d for d in dirs if not ignored(base + [d]))
            for name in sorted(files):
                if ignored(base + [name]):
                    continue
                yield self._row(p, f"{rel_root}/{name}", os.path.join(root, name), seq)
                seq += 1


# ---------------------------------------------------------------------------
# Listing at scale: the driver lists only the root folder's names.
# ---------------------------------------------------------------------------

UNIT_SCHEMA = "repo_id string, tree_root string, entry string, position int"
_CHUNK = 10_000
_CHUNK_CHARS = 16_000_000


@dataclass
class NamesPart(InputPartition):
    names: list


class TreeUnitReader(DataSourceReader):
    def __init__(self, root: str, num_partitions: int):
        self.root = root
        self.num_partitions = max(1, num_partitions)

    def partitions(self):
        names = sorted(os.listdir(self.root))
        n = min(self.num_partitions, max(1, len(names)))
        return [NamesPart(names[k::n]) for k in range(n)]

    def read(self, partition: NamesPart):
        for repo_id in partition.names:
            tree = os.path.join(self.root, repo_id)
            if not os.path.isdir(tree):
                continue
            yield (repo_id, tree, None, 0)
            for i, e in enumerate(_directories(tree), start=1):
                if not ignored([e]):
                    yield (repo_id, tree, e, i)


class TreeUnitSource(DataSource):
    """``format("tree_units")``: (tree, top-level entry) units; trees listed in tasks."""

    @classmethod
    def name(cls):
        return "tree_units"

    def schema(self):
        return UNIT_SCHEMA

    def reader(self, schema):
        return TreeUnitReader(self.options["path"], int(self.options.get("numPartitions", "64")))


def _walk_units(read_content: str):
    import pandas as pd

    cols = ["repo_id", "file_seq", "relative_path", "size", "content", "text_ok"]

    def run(batches):
        walker = TreeWalker(read_content)
        for pdf in batches:
            rows, held = [], 0
            for u in pdf.itertuples(index=False):
                unit = TreeUnit(u.repo_id, u.tree_root, u.entry if isinstance(u.entry, str) else None,
                                int(u.position))
                for row in walker.walk(unit):
                    rows.append(row)
                    held += len(row[4] or "")
                    if len(rows) >= _CHUNK or held >= _CHUNK_CHARS:
                        yield pd.DataFrame(rows, columns=cols)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=cols)
    return run


def scan_trees(spark, root: str, content: str = "py", num_partitions: int | None = None):
    """One row per file of every tree under ``root`` (ignored paths pruned).

    Trees are listed by tasks and their units walked after a hash spread; the
    driver lists only the root folder's names. ``root`` is a path that all
    executors have mounted; a URI with a scheme is refused.
    ``num_partitions`` defaults to twice the cluster's default parallelism.
    """
    from treeline.session import ship_package
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+:/", root):
        raise ValueError(f"scan_trees reads mounted folders, not {root!r}")
    ship_package(spark)
    spark.dataSource.register(TreeUnitSource)
    n = num_partitions or 2 * spark.sparkContext.defaultParallelism
    units = spark.read.format("tree_units").option("numPartitions", str(n)).load(root)
    return (units.repartition(n, "repo_id", "entry")
            .mapInPandas(_walk_units(content), schema=SCHEMA))
