"""N-gram Jaccard join with an LSH forest of MinHash signatures.

1. Equal texts make one class (key: MD5 of the text). Every class has a
   signature of ``TREES * DEPTH`` 16-bit minima over its word shingles.
2. A tree sorts the classes by its ``DEPTH`` minima, a prefix trie laid out by
   the ``SHORTEST`` first of them; classes that share those meet in a cell.
   Cells above ``BLOCK`` members or ``BLOCK_BYTES`` of text are dealt into pairs
   of blocks, so a task holds no more than two blocks, and of each text only its
   shingles. A pair belongs to the first tree it meets in.
3. From the depth of the longest shared prefix and the estimated similarity of
   all pairs met, the prefixes are shortened from ``DEPTH`` on until the
   recall estimated for pairs at or above the threshold reaches the target.
   That depth is only reported: it is an estimate over all pairs together, in
   which a large group of very similar texts outweighs marginal pairs elsewhere.
4. All pairs met and left by signature (threshold less five standard errors)
   are verified, whatever the depth of their prefix, on the exact shingle sets
   of the whole texts, many pairs of a cell at once.
   A cell gives one row per linked class (its links there, its local group),
   never a row per pair; link counts add up as each pair has one owner.
5. Groups are joined to components in Spark.

Defined results: words are runs of non-blank bytes, A-Z lower-cased; a text of
one to four words is a single shingle; null equals empty; wordless texts link
to nothing; null or repeated ids keep one row per input row; empty tables give
empty results. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, ascii_classes, keyed, mixed, new_owner, owned, row_slices, span_hashes, stored, text_buffer
from .components import components

TREES, DEPTH, SHORTEST = 32, 8, 4
BLOCK, BLOCK_BYTES = 512, 16 << 20
WORD_BYTES = ascii_classes(lambda b: b not in b"\x00\t\n\x0b\x0c\r ")
_SLICE = 2 << 20
_draw = np.random.default_rng(8)
_MULTIPLIERS = _draw.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_ADDENDS = _draw.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


# -- shingles and signatures -------------------------------------------------


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of a slice, and the bounds by row."""
    n = np.diff(words.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(bounds[-1]) + np.repeat(words.first[:-1] - bounds[:-1], count)
    last = first + np.repeat(np.minimum(n, k), count) - 1
    return span_hashes(words.canon, words.start[first], words.end[last]), bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, TREES * DEPTH) 16-bit minima; rows without shingles are 0."""
    out = np.zeros((len(bounds) - 1, TREES * DEPTH), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        starts = bounds[:-1][full]
        for p in range(TREES * DEPTH):
            least = np.minimum.reduceat(x * _MULTIPLIERS[p] + _ADDENDS[p], starts)
            out[full, p] = (mixed(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return out


def _signature_rows(k: int):
    def run(batches):
        for b in batches:
            data, offsets = text_buffer(b["text"])
            for lo, hi in row_slices(offsets, _SLICE):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WORD_BYTES)
                sig = signatures(*shingle_hashes(words, k))
                sig_col = pa.array([s.tobytes() if n else None for s, n in zip(sig, np.diff(words.first).tolist(), strict=True)], pa.binary())
                size = pa.array(np.diff(offsets[lo : hi + 1]), pa.int64())
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(lo, hi - lo), b["key"].slice(lo, hi - lo), sig_col, size], ["doc_id", "key", "sig", "bytes"])

    return run


def _tree_rows(batches):
    for b in batches:
        n = len(b)
        sig = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint16).reshape(n, TREES, DEPTH)
        prefix = np.ascontiguousarray(sig[:, :, :SHORTEST]).view("<i8").reshape(n, TREES)
        for t in range(TREES):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.ascontiguousarray(prefix[:, t])), b["key"], b["bytes"]], ["tree", "prefix", "key", "bytes"])


# -- pairs of a cell ---------------------------------------------------------


def _pairs_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs (a < b) within consecutive groups of the given sizes."""
    starts = np.cumsum(sizes) - sizes
    last = np.repeat(starts + sizes, sizes)  # end of each member's group
    later = last - np.arange(len(last)) - 1
    a = np.repeat(np.arange(len(last)), later)
    ends = np.cumsum(later)
    return a, a + 1 + np.arange(len(a)) - np.repeat(ends - later, later)


def judge(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs: equal minima, first tree sharing the shortest prefix, longest shared prefix."""
    same = (sig[a] == sig[b]).reshape(len(a), TREES, DEPTH)
    run = np.cumprod(same, axis=2, dtype=np.uint8).sum(axis=2)
    return same.sum(axis=(1, 2)), (run >= SHORTEST).argmax(axis=1), run.max(axis=1)


def _cells(least_equal: int):
    """Cells with the pairs they own that may reach the threshold; rows come sorted by cell."""

    def run(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        for b in batches:
            cut = _last_start(b)
            if cut == 0:
                held.append(b)
                continue
            done = pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
            out, serial = _owned(done, serial, least_equal)
            yield from out
        if held:
            yield from _owned(pa.Table.from_batches(held), serial, least_equal)[0]

    return run


def _last_start(b: pa.RecordBatch) -> int:
    """Where the last cell of the batch starts (0 if one cell fills it)."""
    c = _cell_of(b)
    other = np.flatnonzero((c != c[-1]).any(axis=1))
    return int(other[-1]) + 1 if len(other) else 0


def _cell_of(b) -> np.ndarray:
    return np.stack([b[n].to_numpy().astype(np.int64) for n in ("tree", "prefix", "i", "j")], axis=1)


def _owned(rows: pa.Table, serial: int, least_equal: int):
    out = []
    cell = _cell_of(rows)
    edges = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
    bounds = np.concatenate([[0], edges, [len(cell)]])
    keys = rows["key"].to_pylist()
    sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint16).reshape(len(keys), -1)
    block = rows["block"].to_numpy()
    sizes = np.diff(bounds)
    lo = 0
    cost = np.cumsum(sizes * (sizes - 1) // 2)
    while lo < len(sizes):  # some thousand pairs at a time, or one cell
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + 20_000, "right")))
        base = int(bounds[lo])
        at = np.repeat(np.arange(lo, hi), sizes[lo:hi])
        a, b = _pairs_of(sizes[lo:hi])
        found = []
        for s in range(0, len(a), 20_000):
            p, q = a[s : s + 20_000], b[s : s + 20_000]
            crossing = cell[base + p, 2] != cell[base + p, 3]
            wanted = ~crossing | (block[base + p] != block[base + q])
            p, q = p[wanted], q[wanted]
            equal, owner, depth = judge(sig[base:], p, q)
            ok = (owner == cell[base + p, 0]) & (equal >= least_equal)
            found.append((p[ok], q[ok], equal[ok], depth[ok]))
        p, q, equal, depth = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
        if len(p):
            home = at[p]
            for c in np.unique(home):
                mine = home == c
                members, index = np.unique(np.concatenate([p[mine], q[mine]]), return_inverse=True)
                half = len(index) // 2
                out.append(
                    pa.RecordBatch.from_pylist(
                        [{"cell": serial, "keys": [keys[base + m] for m in members.tolist()], "a": index[:half].astype("<i4").tobytes(), "b": index[half:].astype("<i4").tobytes(), "equal": np.minimum(equal[mine], 255).astype(np.uint8).tobytes(), "depth": depth[mine].astype(np.uint8).tobytes()}],
                        schema=_CELL,
                    )
                )
                serial += 1
        lo = hi
    return out, serial


_CELL = pa.schema([("cell", pa.int64()), ("keys", pa.list_(pa.binary())), ("a", pa.binary()), ("b", pa.binary()), ("equal", pa.binary()), ("depth", pa.binary())])
_CELL_SQL = "cell long, keys array<binary>, a binary, b binary, equal binary, depth binary"


# -- recall ------------------------------------------------------------------


def meeting_chance(similarity: np.ndarray, depth: int) -> np.ndarray:
    """Chance that two texts share a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def choose_depth(counts: np.ndarray, threshold: float, target: float) -> tuple[int, float]:
    """Longest prefix whose estimated recall reaches the target, and that recall.

    ``counts[d, e]``: pairs whose longest shared prefix is ``d`` and that share
    ``e`` minima. Every pair stands for 1 / (its chance to be met at all).
    """
    similarity = np.arange(counts.shape[1]) / (TREES * DEPTH)
    counts = counts[:, similarity >= threshold]
    similarity = similarity[similarity >= threshold]
    everything = (counts.sum(axis=0) / meeting_chance(similarity, SHORTEST)).sum()
    for depth in range(DEPTH, SHORTEST, -1):
        found = counts[depth:].sum()
        if not everything or found >= target * everything:
            return depth, float(found / everything) if everything else 1.0
    return SHORTEST, float(counts.sum() / everything)


def _depth_counts(cells: DataFrame, owner: str) -> np.ndarray:
    def count(batches):
        n = np.zeros((DEPTH + 1) * 256, np.int64)
        for b in batches:
            equal = np.frombuffer(b"".join(b["equal"].to_pylist()), np.uint8)
            depth = np.frombuffer(b"".join(b["depth"].to_pylist()), np.uint8)
            n += np.bincount(depth.astype(np.int64) * 256 + equal, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["at", "n"])

    out = np.zeros((DEPTH + 1) * 256, np.int64)
    for r in cells.select("equal", "depth").mapInArrow(owned(owner, count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(DEPTH + 1, 256)


# -- exact verification ------------------------------------------------------


def exact_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sorted distinct hash arrays have Jaccard similarity >= threshold."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(a) <= 3 * len(sets):
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    else:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        row, column = row[shared], column[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both_all = np.zeros((len(sets), len(sets)), np.float32)
        step = max(256, (4 << 20) // (4 * len(sets)))
        values = np.unique(column)
        for lo in range(0, len(values), step):  # columns in slices: bounded memory
            hi = min(lo + step, len(values))
            x, y = np.searchsorted(column, values[lo], "left"), np.searchsorted(column, values[hi - 1], "right")
            m = np.zeros((len(sets), hi - lo), np.float32)
            m[row[x:y], np.searchsorted(values[lo:hi], column[x:y])] = 1
            both_all += m @ m.T
        both = np.rint(both_all[a, b]).astype(np.int64)
    union = size[a] + size[b] - both
    return both >= threshold * union - 1e-9


def _groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each member's linked group."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(k: int, threshold: float):
    """Links of cells; a cell comes as its header (pairs) and then its texts by position."""

    def run(batches):
        state: dict = {}

        def shingle():
            """Texts read so far become sorted shingle hashes; the texts go."""
            texts = [t.encode() for t in state["texts"]]
            state["texts"], state["held"] = [], 0
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            for lo, hi in row_slices(offsets, _SLICE):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WORD_BYTES)
                h, bounds = shingle_hashes(words, k)
                state["sets"].extend(np.unique(h[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))

        def finish():
            if not state:
                return None
            a, b = (np.frombuffer(state[x], "<i4") for x in "ab")
            shingle()
            sets = state["sets"]
            ok = exact_links(sets, a, b, threshold)
            a, b = a[ok], b[ok]
            n = np.bincount(a, minlength=len(sets)) + np.bincount(b, minlength=len(sets))
            group = _groups(len(sets), a, b)
            linked = np.flatnonzero(n)
            keys = state["keys"]
            return [(keys[i], int(n[i]), keys[group[i]]) for i in linked.tolist()]

        def rows(found):
            c = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary())], ["key", "n", "root"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["pos"] < 0:
                    if found := finish():
                        yield rows(found)
                    state = {"a": r["a"], "b": r["b"], "texts": [], "keys": [], "sets": [], "held": 0}
                else:
                    state["texts"].append(r["text"])
                    state["keys"].append(r["key"])
                    state["held"] += len(r["text"])
                    if state["held"] > _SLICE:
                        shingle()
        if found := finish():
            yield rows(found)

    return run


# -- the join ----------------------------------------------------------------


def similarity_links(docs: DataFrame, threshold: float = 0.8, k: int = 5, target_recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, tuple[int, float]]:
    """(documents with key, links by key, (prefix depth, estimated recall)).

    The depth is the longest at which the recall estimated over all pairs would
    reach the target; links come from all pairs that meet at ``SHORTEST``.
    Links: (key, n, root) - of each linked class the classes it links to in a
    cell, and one member of its group there.
    """
    rows = keyed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    owner = new_owner()
    signed = stored(rows.select("doc_id", "key", "text").mapInArrow(owned(owner, _signature_rows(k)), "doc_id long, key binary, sig binary, bytes long"), "forest-signed")
    classes = signed.where("sig is not null").groupBy("key").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("rep"), F.first("bytes").alias("bytes"))
    classes = stored(classes, "forest-classes")
    trees = classes.select("key", "sig", "bytes").mapInArrow(owned(owner, _tree_rows), "tree int, prefix long, key binary, bytes long")
    met = trees.groupBy("tree", "prefix").agg(F.count("*").alias("size"), F.sum("bytes").alias("total")).where("size > 1")
    members = trees.drop("bytes").join(met, ["tree", "prefix"]).join(classes.select("key", "sig"), "key")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int")
    members = members.withColumn("block", F.pmod(F.xxhash64("key", F.lit(3)), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.select("tree", "prefix", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "sig")
    cell = ["tree", "prefix", "i", "j"]
    margin = 5 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5
    least_equal = int(np.ceil((threshold - margin) * TREES * DEPTH))
    ordered = members.repartition(*cell).sortWithinPartitions(*cell)
    cells = stored(ordered.mapInArrow(owned(owner, _cells(least_equal)), _CELL_SQL), "forest-cells")
    depth, recall = choose_depth(_depth_counts(cells, owner), threshold, target_recall)
    places = cells.select("cell", F.posexplode("keys").alias("pos", "key"))
    needed = places.select("key").distinct().join(classes.select("key", "rep"), "key")
    texts = rows.join(needed, (rows["key"] == needed["key"]) & rows["doc_id"].eqNullSafe(needed["rep"])).select(rows["key"], "text").dropDuplicates(["key"])
    none = F.lit(None).cast("binary")
    bodies = places.join(texts, "key").select("cell", "pos", "key", "text", none.alias("a"), none.alias("b"))
    heads = cells.select("cell", F.lit(-1).alias("pos"), none.alias("key"), F.lit(None).cast("string").alias("text"), "a", "b")
    together = bodies.unionByName(heads).repartition("cell").sortWithinPartitions("cell", "pos")
    links = stored(together.mapInArrow(owned(owner, _verify(k, threshold)), "key binary, n long, root binary"), "forest-links")
    return signed.select("doc_id", "key"), links, (depth, recall)


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, k: int = 5, target_recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, class_id, n_links, n_copies).

    ``class_id`` is the least doc_id of its component of links (equal texts
    included), ``n_links`` the number of different texts with similarity at or
    above the threshold, ``n_copies`` the rows with the very same text.
    """
    signed, links, _ = similarity_links(docs, threshold, k, target_recall, id_col, text_col)
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    linked = components(links.select(F.col("key").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "key")
    counts = links.groupBy("key").agg(F.sum("n").alias("n_links"))
    of = classes.join(linked, "key", "left").join(counts, "key", "left")
    of = of.select("key", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "key").alias("label"), "least")
    of = stored(of, "forest-classes")
    first = of.groupBy("label").agg(F.min("least").alias("class_id"))
    of = of.join(first, "label").select("key", "class_id", "n_links", "n_copies")
    return signed.join(of, "key").select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, threshold: float = 0.8, k: int = 5, target_recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class (the least id; of repeated ids one row), with all its columns."""
    row, key = (n + "_" * sum(len(c) for c in docs.columns) for n in ("row", "id"))  # longer than any name there
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "forest-docs")
    classes = near_duplicate_classes(numbered, threshold, k, target_recall, row, text_col).select(F.col("doc_id").alias(row), "class_id")
    ids = numbered.select(row, F.col(f"`{id_col}`").alias(key))
    chosen = ids.join(classes, row).groupBy("class_id").agg(F.min(F.struct(F.col(key).isNull(), key, row)).getField(row).alias(row))
    return numbered.join(chosen.select(row), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
