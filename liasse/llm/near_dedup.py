"""Near-duplicate documents by SetSketch registers.

A document's set is that of its 5-word shingles (words are runs of other
characters than blanks, A-Z in lower case; a shorter text is one shingle; a text
without words has none and is linked with nothing).  Register ``i`` of its sketch
holds the exponentially spaced, truncated minimum of the ``i``-th hash over the
set: ``1 - log_b(min)`` rounded down.  Registers of a union are the larger ones
of both, and two registers are equal about as often as the sets' similarity says.

1. Documents with equal sets are one class; only classes are compared.
2. Bands of ``ROWS`` registers put classes in buckets, as many (``bands_for``)
   that a pair at the limit shares none of them once in two million times.
3. Within a bucket, classes are compared with leaders, about ``FIRST_LEADERS``
   at first and ``GROWTH`` times as many each round.  Classes that are linked already, directly
   or not, are not compared again, and a bucket whose classes are all linked is
   done.  A bucket is left when all its classes were leaders, so no pair is lost
   to the size of a bucket, and none of a linked group's pairs are listed.
4. A pair's similarity is estimated from both sketches by maximum likelihood;
   pairs over five standard errors below the limit are no candidates.
5. The others are verified on the full sets: classes with a candidate meet once
   more in their bucket, each with its set, and only links leave it, so near
   misses cost rows by their number, not by their pairs.  Links are joined to
   components.

Null ids take part; a component is named by its smallest id, null if it has
none.  Rows that agree in id and text are each returned, with one result.  Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, write_checkpoint

SHINGLE = 5
REGISTERS = 256
ROWS, MISSED = 5, 5e-7  # registers of a band; share of pairs at the limit that may meet in no band
BASE = 1.001
RATE = 20.0
FIRST_LEADERS, GROWTH = 2, 8
CHUNK = 2048  # members that one block compares with leaders
PERCENT = 85  # the limit of a link in op1's contract
SLICE_ITEMS = 4_000_000  # shingles of the leaders that a task verifies members against
MOST_SENT = 2_000_000
WORDS_KEPT = 500_000  # words a task remembers; affects speed only

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FACTORS = _mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
TERMS = _mix(np.arange(REGISTERS + 1, 2 * REGISTERS + 1, dtype=np.uint64) * _ODD)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, seen: Hashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter((seen[w] for w in words), np.uint64, len(words))
    if not len(h):
        return h
    k = min(SHINGLE, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for d in range(k):
        out = _mix((out + h[d:d + len(out)]) * _ODD)
    return np.unique(out)


def registers(found: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 512):
        x = found[start:start + 512, None] * FACTORS[None, :]
        x += TERMS
        np.minimum(least, x.min(axis=0), out=least)
    u = (least.astype(np.float64) + 1.0) / 2.0**64
    value = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(1 + np.floor(-np.log(value) / np.log(BASE)), 0, 65535).astype(np.uint16)


def bands_for(percent: int) -> int:
    """How many bands a limit needs (25 for 85, 37 for 80)."""
    bands = 1 if percent >= 100 else int(np.ceil(np.log(MISSED) / np.log1p(-((percent / 100) ** ROWS))))
    if bands * ROWS > REGISTERS:
        raise ValueError(f"a limit of {percent} % takes {bands} bands of {ROWS}, a sketch has {REGISTERS} registers")
    return bands


def least_estimate(percent: int) -> float:
    """Five standard errors below the limit."""
    limit = percent / 100
    return limit - 5 * (limit * (1 - limit) / REGISTERS) ** 0.5


def band_keys(sketches: np.ndarray, bands: int) -> np.ndarray:
    """A key for each sketch and band."""
    x = sketches[:, :bands * ROWS].reshape(-1, bands, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), x.shape[:2]) * _ODD
    for d in range(ROWS):
        key = _mix((key + x[:, :, d] + np.uint64(1)) * _ODD)
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarities by maximum likelihood from how many registers are larger in either sketch, or equal."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1 - 1e-12)

    def gain(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        x, y = low + (high - low) * 0.382, low + (high - low) * 0.618
        rising = gain(x) < gain(y)
        low, high = np.where(rising, x, low), np.where(rising, high, y)
    return (low + high) / 2


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, a, b, n, node, sketch``: each row's key, the size and 128-bit name of its set, and its registers."""
    i, t = F.col(doc_id), F.col(text)
    rows = docs.select(t.alias("text"), i.alias("doc_id"), F.xxhash64(i, t).alias("a"), F.xxhash64(F.lit(1), t, i).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Hashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                n, node, sketch = [], [], []
                for text in batch.column(0).to_pylist():
                    found = shingles(text, seen)
                    n.append(len(found))
                    node.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    sketch.append(registers(found).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sketch, pa.binary())],
                                                 names=["doc_id", "a", "b", "n", "node", "sketch"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, a long, b long, n long, node binary, sketch binary")


def buckets(classes: DataFrame, bands: int) -> DataFrame:
    """``bucket, node`` for each class and band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS), bands)
                at = pa.array(np.repeat(np.arange(batch.num_rows), bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(at)], names=["bucket", "node"])
    return classes.select("node", "sketch").mapInArrow(run, "bucket long, node binary")


def _merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A sort-merge join: the rounds have many joins, whose small sides would each be built and held on the driver."""
    return left.join(right.hint("merge"), on, how)


def _members(classes: DataFrame, bands: int) -> DataFrame:
    """``bucket, size, node`` of the buckets with two classes or more."""
    rows = buckets(classes, bands)
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return write_checkpoint(_merged(rows, shared, "bucket"))


def _place(node: Column, size: Column) -> Column:
    """Where a class stands in a bucket: its name as a number from 0 to the bucket's size."""
    return F.conv(F.hex(F.substring(node, 1, 6)), 16, 10).cast("double") / F.lit(2.0**48) * size


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``node, items``: the sorted hashes of the set of each class; ``wanted`` has a row's key for each."""
    if wanted.count() <= MOST_SENT:
        wanted = F.broadcast(wanted)
    i, t = F.col(doc_id), F.col(text)
    rows = docs.select(F.xxhash64(i, t).alias("a"), F.xxhash64(F.lit(1), t, i).alias("b"), t.alias("text")).join(wanted, ["a", "b"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Hashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                items = [shingles(t, seen).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], names=["node", "items"])

    return rows.mapInArrow(run, "node binary, items binary").dropDuplicates(["node"])


class _Block:
    """Rows of leaders or members as arrays."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.bucket, self.chunk, self.kind, self.place = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        self.comp = np.array([int.from_bytes(c[:8], "little", signed=True) for c in batch.column(4).to_pylist()], np.int64)
        self.node = np.array(batch.column(5).to_pylist() + [None], object)[:-1]
        self.n = batch.column(6).to_numpy(zero_copy_only=False)
        self.sketch = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint16).reshape(-1, REGISTERS)

    names = ("bucket", "chunk", "kind", "place", "comp", "node", "n", "sketch")

    def after(self, held: "_Block | None") -> "_Block":
        """These rows with those of ``held`` before them."""
        if held is not None:
            for c in self.names:
                setattr(self, c, np.concatenate([getattr(held, c), getattr(self, c)]))
        return self

    def part(self, rows: np.ndarray) -> "_Block":
        out = object.__new__(_Block)
        for c in self.names:
            setattr(out, c, getattr(self, c)[rows])
        return out


def _likely(rows: _Block, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (x, y) of rows that are not linked, meet here first and reach the estimate."""
    on = (rows.comp[x] != rows.comp[y]) & ((rows.place[x] < rows.place[y]) | (rows.place[x] == rows.place[y]) & (rows.node[x] < rows.node[y]))
    x, y = x[on], y[on]
    least, bands = least_estimate(percent), bands_for(percent)
    small, large = np.minimum(rows.n[x], rows.n[y]), np.maximum(rows.n[x], rows.n[y])
    same = (rows.sketch[x] == rows.sketch[y]).sum(axis=1)
    on = (100 * small >= percent * large) & (same >= (least - 0.1) * REGISTERS)
    x, y = x[on], y[on]
    if len(x):
        on = estimate(rows.sketch[x], rows.sketch[y], rows.n[x], rows.n[y]) >= least
        x, y = x[on], y[on]
    if len(x):
        common = band_keys(rows.sketch[x], bands)
        alike = common == band_keys(rows.sketch[y], bands)
        on = common[np.arange(len(x)), alike.argmax(axis=1)] == rows.bucket[x]
        x, y = x[on], y[on]
    return x, y


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """``bucket, chunk, slice, kind, comp, node``: the leaders (``kind`` 0) and members (1) that have a candidate pair in their block.

    ``rows`` holds leaders before members of each bucket and chunk.  A candidate
    pair is a leader and a later member, not linked yet, whose estimate is near
    ``percent`` or over it; it comes from its first common bucket only.  Pairs
    are not listed, so a group of n near misses gives some n rows a band.  The
    leaders of a block are cut into slices of ``SLICE_ITEMS`` shingles.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Block | None = None  # leaders of the block that the batch before ended in
        for whole in batches:
            for offset in range(0, whole.num_rows, 4096):
                rows = _Block(whole.slice(offset, 4096)).after(held)
                edges = np.flatnonzero(np.append(True, (rows.bucket[1:] != rows.bucket[:-1]) | (rows.chunk[1:] != rows.chunk[:-1])))
                ones, twos, pairs, waiting = [], [], 0, []
                slice_of = np.zeros(len(rows.n), np.int64)
                for start, end in zip(edges.tolist(), [*edges[1:].tolist(), len(rows.n)]):
                    middle = start + int((rows.kind[start:end] == 0).sum())
                    slice_of[start:middle] = np.cumsum(rows.n[start:middle]) // SLICE_ITEMS
                    for lead in range(start, middle, 64):
                        few = np.arange(lead, min(lead + 64, middle))
                        waiting.append((np.repeat(few, end - middle), np.tile(np.arange(middle, end), len(few))))
                        pairs += len(waiting[-1][0])
                        if pairs > 100_000:
                            for kept, found in zip((ones, twos), _likely(rows, *map(np.concatenate, zip(*waiting)), percent)):
                                kept.append(found)
                            waiting, pairs = [], 0
                if waiting:
                    for kept, found in zip((ones, twos), _likely(rows, *map(np.concatenate, zip(*waiting)), percent)):
                        kept.append(found)
                last = np.arange(edges[-1], len(rows.n))
                held = rows.part(last[rows.kind[last] == 0])
                none = np.zeros(0, np.int64)
                x, y = np.concatenate([*ones, none]), np.concatenate([*twos, none])
                # Rows are once a slice here, however many candidates they have.
                picked = np.unique(np.stack([np.concatenate([x, y]), np.tile(slice_of[x], 2)]), axis=1)
                at = picked[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (rows.bucket[at], rows.chunk[at], picked[1], rows.kind[at], rows.comp[at])] + [pa.array(rows.node[at].tolist(), pa.binary())],
                    names=["bucket", "chunk", "slice", "kind", "comp", "node"])

    return rows.select("bucket", "chunk", "kind", "place", "comp", "node", "n", "sketch").repartition("bucket", "chunk").sortWithinPartitions(
        "bucket", "chunk", "kind").mapInArrow(run, "bucket long, chunk long, slice long, kind int, comp long, node binary")


def _links(leaders: dict[bytes, tuple[int, np.ndarray]], nodes: list[bytes], comps: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between leaders (name to component and set) and members, by their full sets; none between what they have linked already."""
    own = [s for _, s in leaders.values()]
    sizes, k = np.array([len(s) for s in sets], np.int64), len(own)
    numbers = np.unique(np.concatenate([*own, *sets]), return_inverse=True)[1]
    ends = np.cumsum([len(s) for s in own])
    members, mark = numbers[ends[-1]:], np.zeros(int(numbers.max()) + 1, bool)
    comp = np.concatenate([np.array([c for c, _ in leaders.values()], np.int64), comps])
    out = []
    for i, name in enumerate(leaders):
        n = len(own[i])
        still = (comp[k:] != comp[i]) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
        at = np.flatnonzero(still)
        if not len(at):
            continue
        items = numbers[ends[i] - n:ends[i]]
        mark[items] = True
        common = np.add.reduceat(mark[members[np.repeat(still, sizes)]], np.cumsum(sizes[at]) - sizes[at], dtype=np.int64)
        mark[items] = False
        good = at[100 * common >= percent * (n + sizes[at] - common)]
        for j in good[np.unique(comp[k + good], return_index=True)[1]].tolist():
            out.append((name, nodes[j]))
            comp[comp == comp[k + j]] = comp[i]
    return out


def _verified(picked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``one, two``: links between the leaders and members of a slice of a block; each one's set comes there once."""
    both = _merged(picked, sets, "node").select("bucket", "chunk", "slice", "kind", "comp", "node", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, leaders = None, {}
        for whole in batches:
            for batch in slices(whole, 6, SLICE_ITEMS * 8):
                keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
                kind, comp = (batch.column(c).to_numpy() for c in (3, 4))
                node = batch.column(5).to_pylist()
                items = [np.frombuffer(x, np.uint64) for x in batch.column(6).to_pylist()]
                edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
                found = []
                for start, end in zip(edges, [*edges[1:], len(keys)]):
                    if keys[start] != block:
                        block, leaders = keys[start], {}
                    middle = start + int((kind[start:end] == 0).sum())
                    leaders.update((node[r], (int(comp[r]), items[r])) for r in range(start, middle))
                    if leaders and middle < end:
                        found += _links(leaders, node[middle:end], comp[middle:end], items[middle:end], percent)
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.binary()) for c in (0, 1)], names=["one", "two"])

    return both.repartition("bucket", "chunk", "slice").sortWithinPartitions("bucket", "chunk", "slice", "kind").mapInArrow(run, "one binary, two binary")


def _joined_labels(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (``node, comp``) after each component takes the least label that a link leads to, once; and the links between components."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"c_{c}"))
    edges = _merged(_merged(links, of("one"), "one"), of("two"), "two").where("c_one <> c_two").select("c_one", "c_two").distinct()
    both = edges.unionByName(edges.select(F.col("c_two").alias("c_one"), F.col("c_one").alias("c_two")))
    down = both.groupBy("c_one").agg(F.min("c_two").alias("to")).where("to < c_one")
    down = write_checkpoint(down)
    # A label that takes another one takes that one's next label at once.
    jump = _merged(down, down.select(F.col("c_one").alias("to"), F.col("to").alias("further")), "to", "left").select("c_one", F.coalesce("further", "to").alias("new"))
    moved = _merged(labels, jump.withColumnRenamed("c_one", "comp"), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return write_checkpoint(moved), down


def link_classes(classes: DataFrame, sets_of, percent: int = PERCENT) -> DataFrame:
    """``node, comp`` for the classes that share a bucket with another one; linked classes have one ``comp``."""
    members = _members(classes, bands_for(percent))
    involved = write_checkpoint(_merged(members.select("node").distinct(), classes.select("node", "n", "sketch", "key"), "node"))
    sets = write_checkpoint(sets_of(involved.select("node", "key.a", "key.b")))
    labels = involved.select("node", F.col("node").alias("comp"))
    place, chunks = _place(F.col("node"), F.col("size")), F.ceil(F.col("size") / CHUNK)
    links, done, count = None, 0, FIRST_LEADERS
    sketches = involved.select("node", "n", "sketch")
    while True:
        known = _merged(members, labels, "node")
        open_buckets = known.where(F.col("size") > done).groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        still = write_checkpoint(open_buckets.select("bucket"))
        if still.isEmpty():
            break
        rows = _merged(known.withColumn("place", place).where(F.col("place") >= done), still, "bucket")
        each = rows.withColumn("chunk", F.floor(F.col("place") / F.col("size") * chunks)).withColumn("kind", F.lit(1))
        lead = each.where(F.col("place") < done + count).withColumn("kind", F.lit(0)).withColumn("chunk", F.explode(F.sequence(F.col("chunk"), chunks - 1)))
        each, lead = each.drop("size"), lead.drop("size")
        picked = _candidates(_merged(each.unionByName(lead), sketches, "node"), percent)
        found = write_checkpoint(_verified(picked, sets, percent))
        links = found if links is None else links.unionByName(found)
        labels, _ = _joined_labels(labels, links)
        done, count = done + count, count * GROWTH
    while links is not None:
        labels, changed = _joined_labels(labels, links)
        if changed.isEmpty():
            break
    return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, a, b, n_shingles, component_id, kept`` for each row; ``a`` and ``b`` are the row's key."""
    rows = write_checkpoint(sketched(docs, doc_id, text))
    classes = write_checkpoint(rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"), F.min(F.struct("a", "b")).alias("key")))
    labels = link_classes(classes, lambda wanted: _sets(docs, wanted, doc_id, text), percent)
    named = _merged(classes.select("node", "least"), labels, "node")
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    linked = _merged(named, smallest, "comp").select("node", "component_id")
    of_class = _merged(classes.select("node", "least"), linked, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = _merged(rows.select("doc_id", "a", "b", F.col("n").alias("n_shingles"), "node"), of_class, "node", "left").withColumn("component_id", component)
    return out.select("doc_id", "a", "b", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and one of rows that agree in id and text."""
    found = near_duplicates(docs, doc_id, text, percent)
    gone = write_checkpoint(found.where(~F.col("kept")).select("a", "b").distinct())
    again = write_checkpoint(found.where("kept").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("a", "b"))
    if gone.count() <= MOST_SENT:
        gone = F.broadcast(gone)
    i, t = F.col(doc_id), F.col(text)
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(i, t).alias("a"), F.xxhash64(F.lit(1), t, i).alias("b")).join(gone, ["a", "b"], "left_anti")
    if not again.isEmpty():
        one = rows.join(again, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.first("row").alias("row")).select("row", "a", "b")
        rows = rows.join(again, ["a", "b"], "left_anti").unionByName(one)
    return rows.select("row.*")
