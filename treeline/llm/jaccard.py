"""N-gram Jaccard join: MinHash LSH forest with exact verification.

Every distinct text is a node with the set of its distinct five-word shingles.
Two texts are linked when the exact Jaccard similarity of their sets is at
least ``threshold``.

The forest has ``TREES`` prefix tries. In each, a text is a path of ``DEPTH``
MinHash values. One sort by (tree, path) makes all tries: texts below a trie
node of any depth lie next to each other, and the longest prefix that a text
shares with a neighbour is the longest that it shares with any text. Texts that
share less than the shortest prefix ever used are in no candidate pair of that
tree and go.

Matched prefixes are shortened by what is found. Pairs below a common node of
depth 8 are verified first. A link of similarity s meets at depth p in some tree
with probability ``r(s, p) = 1 - (1 - s^p)^TREES``, so each verified link
stands for 1 / r(s, p) links, and the similarities of the verified links say how
many more would be met at a smaller depth. The depth becomes the largest one whose
estimated recall reaches the target, only pairs that did not meet before are
verified there, and the estimate is made again, until it reaches the target.
One unseen link at the threshold is always added, so few links never end the search
early. ``prefix_length`` is the floor: the depth at which even a pair at exactly the
threshold meets with the target recall (4 for 24 trees, 0.8 and 0.99999).

Steps, each with bounded groups:

1. One scan makes each text's key (md5), its sizes and its paths; exact copies
   meet in a partial aggregation, so a text of any number of copies is one node
   from then on.
2. Paths are sorted by range, so a prefix in a third of all texts spreads over
   tasks; the rows at the ends of a range keep their whole path.
3. Trie nodes with two texts or more are work units. A larger node is cut into
   blocks by a hash of the text, and each pair of blocks is a unit: no unit
   holds more than about ``2 * BLOCK`` texts or ``2 * BLOCK_CHARS`` characters,
   however large the group of near copies is.
4. A pair belongs to the first tree in which it meets; units drop the texts
   that have no pair of their own before any text is moved.
5. Units receive their texts and verify their pairs: intersections of all
   pairs of a unit at once as products of 0/1 matrices in column chunks.
   A unit returns per text its number of links and one edge to its component
   within the unit, so rows grow with texts and units, not with pairs.
6. Links are summed per text, edges become components.

Defined results: null counts as empty. A text without words has no shingles
and is linked to nothing but its exact copies; a text of one to four words is
one shingle of all its words. Exact copies are linked to each other
(similarity 1). Texts that differ in punctuation or ASCII case only have equal
sets and similarity 1. Repeated rows are copies like any others. A null doc_id
ranks last when the least id of a class is taken, and is kept as null. Other
columns are ignored by ``classes`` and passed through by ``dedupe``, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import each_batch, groups, text_key
from treeline.llm.components import components
from treeline.llm.words import (mix64, row_shingles, shingles, slices, stream, text_bytes,
                                words)
from treeline.session import write_table

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
STEP = 2               # bytes of a path for each MinHash value
TARGET_RECALL = 0.99999
BINS = 40              # of the similarities of verified links, between threshold and 1
BLOCK = 256
BLOCK_CHARS = 8_000_000


def recall(similarity: float, prefix: int, trees: int = TREES) -> float:
    return 1.0 - (1.0 - similarity ** prefix) ** trees


def prefix_length(threshold: float, target: float = TARGET_RECALL, trees: int = TREES,
                  depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets the target recall: the floor."""
    for prefix in range(depth, 0, -1):
        if recall(threshold, prefix, trees) >= target:
            return prefix
    raise ValueError(f"{trees} trees cannot reach a recall of {target} at {threshold}")


def estimated_recall(found: np.ndarray, threshold: float, met: int, depth: int,
                     trees: int = TREES) -> float:
    """Share of all links that meet at ``depth``, as estimated from those that met at ``met``.

    ``found``: number of verified links in equal bins of similarity from the threshold
    to 1; each bin counts at its lower end, and one unseen link at the threshold is added.
    """
    low = threshold + (1 - threshold) * np.arange(len(found)) / len(found)
    total = found / recall(low, met, trees)
    missed = np.sum(total * (1 - recall(low, depth, trees))) + 1 - recall(threshold, depth, trees)
    return float(1 - missed / (np.sum(total) + 1))


def _paths(s: np.ndarray, number: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """Paths (rows x trees x depth) of rows with ``number`` shingles each (all > 0)."""
    starts = np.cumsum(number) - number
    factor, shift = stream(0xF0, depth * trees) | np.uint64(1), stream(0xF1, depth * trees)
    out = np.empty((len(number), trees * depth), "<u2")
    with np.errstate(over="ignore"):
        for k in range(trees * depth):
            # A random order of the (already scrambled) shingles: their high bits after a
            # multiplication. Of the least value the low 16 bits are kept: those of a small
            # number are even, and equal ones of different values only add candidates.
            least = np.minimum.reduceat((s * factor[k] + shift[k]) >> np.uint64(32), starts)
            out[:, k] = least & np.uint64(0xFFFF)
    return out


def signatures(docs: DataFrame, n: int, depth: int, trees: int) -> DataFrame:
    """(key, doc_id, rows, chars, paths) of every distinct text; paths: null without shingles,
    else ``trees`` paths one after the other."""
    def sign(batches):
        for batch in batches:
            texts = batch.column("text")
            buf, offsets = text_bytes(texts)
            paths: list[bytes | None] = [None] * batch.num_rows
            for i, j in slices(offsets, 1 << 20):
                h, c = words(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                s, m = shingles(h, c, n)
                has = np.flatnonzero(m)
                if len(has):
                    for k, path in zip((i + has).tolist(), _paths(s, m[has], depth, trees)):
                        paths[k] = path.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"),
                 pa.array(np.diff(offsets)), pa.array(paths, pa.binary())],
                names=["key", "doc_id", "chars", "paths"])

    source = docs.select(text_key(F.col("text").cast("string")).alias("key"),
                         F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    rows = each_batch(source, sign, "key binary, doc_id long, chars long, paths binary")
    return rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"),
                                   F.max("chars").alias("chars"), F.first("paths").alias("paths"))


def _values(column, width: int) -> np.ndarray:
    """MinHash values (rows x width) of a column of paths without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<u2").reshape(len(column), width)


def _shared(tree: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many first values each row shares with the row before it (from the second row on)."""
    same = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def _matched(depth: int, floor: int):
    """Sorted paths -> those that share ``floor`` values or more with a neighbour, and how many
    (``matched``). The first and the last row of a task keep their whole path."""
    def match(batches):
        held, before = None, depth

        def row(batch, matched):
            keep = matched >= floor
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(matched.astype(np.int32))],
                    names=[*batch.schema.names, "matched"]).filter(pa.array(keep))

        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            shared = _shared(batch.column("tree").to_numpy(), _values(batch.column("path"), depth))
            left = np.concatenate([[before], shared])
            yield from row(batch.slice(0, batch.num_rows - 1), np.maximum(left[:-1], shared))
            held, before = batch.slice(batch.num_rows - 1), int(left[-1])
        if held is not None:
            yield from row(held, np.array([depth]))
    return match


def _tries(nodes: DataFrame, depth: int, floor: int, trees: int) -> DataFrame:
    """(tree, path, key, chars, matched): every text of every tree that a prefix of ``floor``
    values or more may lead to another text."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    size = STEP * depth
    filed = (nodes.filter("paths IS NOT NULL").select("key", "chars", "paths", tree)
             .select("tree", F.expr(f"substring(paths, {size} * tree + 1, {size})").alias("path"),
                     "key", "chars"))
    # The key splits a path that very many texts have in common.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "path", "key"]
    return each_batch(filed.repartitionByRange(parts, *order).sortWithinPartitions(*order),
                      _matched(depth, floor), "tree int, path binary, key binary, chars long, matched int")


def _units(tries: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(unit, tree, side, within, key, rows, paths): trie nodes of that depth with several texts,
    cut into block pairs."""
    filed = (tries.filter(F.col("matched") >= depth)
             .select("tree", F.expr(f"substring(path, 1, {STEP * depth})").alias("prefix"),
                     "key", "chars"))
    size = (filed.groupBy("prefix", "tree").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
            .filter("n > 1")
            .select("prefix", "tree", F.greatest(F.ceil(F.col("n") / BLOCK),
                                                 F.ceil(F.col("c") / BLOCK_CHARS)).alias("blocks")))
    member = filed.drop("chars").join(size, ["prefix", "tree"])
    # Text keys are md5 values: their bytes deal texts evenly over the blocks.
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block")
    member = member.select("prefix", "tree", "key", "blocks", block)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    paired = member.select("prefix", "tree", "key", "block", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    unit = F.xxhash64("prefix", "tree", low, high).alias("unit")
    return (paired.select(unit, "tree", (F.col("block") > F.col("other")).cast("int").alias("side"),
                          (F.col("block") == F.col("other")).alias("within"), "key")
            .join(nodes.select("key", "rows", "paths"), "key"))


def _own_pairs(labels: np.ndarray, tree: int, side: np.ndarray, within: bool,
               deeper: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of a unit meet here and in no earlier trie (upper triangle), and nowhere at the
    depth before (``deeper``: labels of that depth)."""
    n = len(labels)
    own = labels[:, tree][:, None] == labels[:, tree][None, :]
    for t in range(tree):
        own &= labels[:, t][:, None] != labels[:, t][None, :]
    for t in range(0 if deeper is None else deeper.shape[1]):
        own &= deeper[:, t][:, None] != deeper[:, t][None, :]
    if not within:
        own &= side[:, None] != side[None, :]
    return own & np.triu(np.ones((n, n), bool), 1)


def _order(batch_rows: pa.Table) -> pa.Table:
    return batch_rows.sort_by([("key", "ascending")]).combine_chunks()


def _labels(values: np.ndarray, depth: int) -> np.ndarray:
    """One 64-bit label (rows x trees) for each prefix of ``depth`` of values (rows x trees x all)."""
    label = np.zeros(values.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, depth, 3):  # 48 bits at a time: exact up to three values
            word = np.zeros_like(label)
            for j in range(k, min(k + 3, depth)):
                word = (word << np.uint64(16)) | values[:, :, j].astype(np.uint64)
            label = mix64(label * np.uint64(0x9E3779B97F4A7C15) + word)
    return label


def _own(group: pa.Table, all_values: int, depth: int, before: int | None) -> np.ndarray:
    """Pairs of a unit that are verified in it; ``before``: the depth used before, if any."""
    paths = group.column("paths").combine_chunks()
    values = _values(paths, len(paths[0].as_buffer()) // STEP).reshape(len(paths), -1, all_values)
    return _own_pairs(_labels(values, depth), group.column("tree")[0].as_py(),
                      group.column("side").to_numpy(), group.column("within")[0].as_py(),
                      None if before is None else _labels(values, before))


def _useful(all_values: int, depth: int, before: int | None):
    """Members of units that have a pair of their own."""
    def useful(batches):
        for group in groups(batches, "unit"):
            group = _order(group)
            own = _own(group, all_values, depth, before)
            keep = own.any(axis=0) | own.any(axis=1)
            if keep.any():
                yield from group.filter(pa.array(keep)).to_batches()
    return useful


def _intersections(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of the pairwise intersections, as products of 0/1 matrices."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True,
                                       return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    row, col = row[keep], column[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((n, n), np.float32)
    for a in range(0, int(shared.sum()), chunk):
        i, j = np.searchsorted(col, [a, a + chunk])
        x = np.zeros((n, chunk), np.float32)
        x[row[i:j], col[i:j] - a] = 1
        total += x @ x.T
    return total


def _links(sets: list[np.ndarray], own: np.ndarray, threshold: float) -> np.ndarray:
    """The pairs of ``own`` with at least ``threshold`` similarity."""
    return _similar(sets, own, threshold)[0]


def _similar(sets: list[np.ndarray], own: np.ndarray, threshold: float
             ) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``own`` with at least ``threshold`` similarity, and their similarities."""
    sizes = np.array([len(s) for s in sets], float)
    if len(sets) > 3:
        both = _intersections(sets)
    else:
        both = np.zeros(own.shape)
        for i, j in zip(*np.nonzero(own)):
            both[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    either = sizes[:, None] + sizes[None, :] - both
    linked = own & (both >= threshold * either - 1e-9)
    return linked, both[linked] / either[linked]


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least member of each member's component of a 0/1 link matrix."""
    label = np.arange(len(linked))
    a, b = np.nonzero(linked)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(n: int, threshold: float, all_values: int, depth: int, before: int | None):
    def verify(batches):
        for group in groups(batches, "unit"):
            group = _order(group)
            own = _own(group, all_values, depth, before)
            sets = [s for _, s in row_shingles(group.column("text"), n)]
            linked, similarity = _similar(sets, own, threshold)
            rows = group.column("rows").to_numpy()
            weight = linked @ rows + linked.T @ rows
            root = _roots(linked)
            some = np.flatnonzero(weight)
            if not len(some):
                continue
            bins = np.minimum((similarity - threshold) / (1 - threshold + 1e-12) * BINS, BINS - 1)
            counts = np.bincount(np.maximum(bins, 0).astype(int), minlength=BINS)
            keys = group.column("key")
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(some)).combine_chunks(),
                 keys.take(pa.array(root[some])).combine_chunks(),
                 pa.array(weight[some].astype(np.int64)),
                 # once for each unit
                 pa.array([counts.tolist(), *[None] * (len(some) - 1)], pa.list_(pa.int64()))],
                names=["a", "b", "links", "bins"])
    return verify


def _by_unit(df: DataFrame) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "unit").sortWithinPartitions("unit")


def _found_at(docs: DataFrame, nodes: DataFrame, tries: DataFrame, n: int, threshold: float,
              all_values: int, depth: int, before: int | None) -> DataFrame:
    """(a, b, links, bins) of the links whose pairs meet at ``depth`` and not at ``before``."""
    fields = ["unit", "tree", "side", "within", "key", "rows", "paths"]
    schema = "unit long, tree int, side int, within boolean, key binary, rows long, paths binary"
    units = _by_unit(_units(tries, nodes, depth)).select(*fields)
    useful = write_table(each_batch(units, _useful(all_values, depth, before), schema), "jaccard-units")
    text = F.col("text").cast("string")
    texts = (docs.select(text_key(text).alias("key"), text.alias("text"))
             .join(useful.select("key").distinct(), "key", "left_semi")
             .dropDuplicates(["key"]))
    with_text = _by_unit(useful.join(texts, "key")).select(*fields, "text")
    found = each_batch(with_text, _verify(n, threshold, all_values, depth, before),
                       "a binary, b binary, links long, bins array<long>")
    return write_table(found, "jaccard-links")


def _binned(found: DataFrame) -> np.ndarray:
    counts = np.zeros(BINS)
    for r in (found.select(F.posexplode("bins").alias("bin", "n")).groupBy("bin")
              .agg(F.sum("n").alias("n")).collect()):  # one row for each bin
        counts[r["bin"]] = r["n"]
    return counts


def links(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD,
          target_recall: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH
          ) -> tuple[DataFrame, DataFrame]:
    """(nodes, found): nodes as of ``signatures``; found (a, b, links) has, for a text ``a``
    and a unit, the rows it is linked to there and a text ``b`` of its component."""
    floor = prefix_length(threshold, target_recall, trees, depth)
    nodes = write_table(signatures(docs, n, depth, trees), "jaccard-nodes")
    tries = write_table(_tries(nodes, depth, floor, trees), "jaccard-tries")
    found, counts, before, at = None, np.zeros(BINS), None, depth
    while True:
        new = _found_at(docs, nodes, tries, n, threshold, depth, at, before)
        found = new if found is None else found.unionByName(new)
        counts += _binned(new)
        reached = [estimated_recall(counts, threshold, at, p, trees) >= target_recall
                   for p in range(at + 1)]
        if reached[at] or at <= floor:
            return nodes, found.select("a", "b", "links")
        shorter = [p for p in range(floor, at) if reached[p]]
        before, at = at, max(shorter, default=floor)


def classes(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD,
            target_recall: float = TARGET_RECALL, trees: int = TREES) -> DataFrame:
    """One row for each distinct text: (key, doc_id, rows, class_key, class_id, n_links).

    ``class_key`` names the connected component, ``class_id`` is its least
    doc_id, ``n_links`` counts the other rows that the text's rows are linked to.
    """
    nodes, found = links(docs, n, threshold, target_recall, trees)
    count = found.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    comp = components(found.select("a", "b"), "jaccard").withColumnRenamed("node", "key")
    full = (nodes.select("key", "doc_id", "rows").join(count, "key", "left")
            .join(comp, "key", "left")
            .select("key", "doc_id", "rows", F.coalesce("component", "key").alias("class_key"),
                    (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links")))
    least = full.groupBy("class_key").agg(F.min("doc_id").alias("class_id"))
    return full.join(least, "class_key")


def join(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: (doc_id, class_id, n_links)."""
    by_text = classes(docs, **options).select("key", "class_id", "n_links")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        text_key(F.col("text").cast("string")).alias("key"))
            .join(by_text, "key").select("doc_id", "class_id", "n_links"))


def dedupe(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, all columns as they are: the least doc_id (null last), then
    the least text key; among rows equal in both, any one."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("key").alias("k"))
    keep = (classes(docs, **options).groupBy("class_key").agg(F.min(rank).alias("r"))
            .select(F.col("r.k").alias("key"), F.col("r.doc_id").alias("keep_id")))
    # The caller's columns travel as one: their names meet none of the names used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       text_key(F.col("text").cast("string")).alias("key"),
                       F.col("doc_id").cast("long").alias("id"))
    return (rows.join(keep, "key").filter(F.col("id").eqNullSafe(F.col("keep_id")))
            .dropDuplicates(["key"]).select("row.*"))
