"""Which tokens of two tokenizers stand for each other, counted over a whole collection.

Both sides encode the same bytes, a space and the text.  Where a token of each ends at
one byte, the two are linked, and such ends cut both sequences into groups.  A pair's
count is the number of its links in all documents.

* First pass: every task aligns its documents and passes on its distinct pairs with their
  numbers of links, which are written down.
* The distinct pairs get a minimal perfect hash (levels of bit arrays; a pair that shares
  its bit goes to the next level).  There are few of them on any input: of two tokens
  that end together one is the ending of the other, so the vocabularies alone bound the
  pairs (``most_pairs``), and the hash is built on the driver.
* The numbers become dense arrays with one entry for each hash value, one array a task,
  added up as a tree of bounded fan-in, in chunks.
* Second pass: every document is aligned again, and each link's count is looked up by its
  hash after the key that is stored there has been compared.

A null or empty text, and one whose tokens of either side do not spell space and text
(characters that a tokenizer rewrites), has no tokens.  Texts are encoded whole, part by
part: before a space or newline that follows a visible character no token of either side
reaches across, so parts are aligned on their own and remembered.  Repeated rows are
aligned one by one and count each.  Other columns pass through; an input that has a column of an output's name is refused.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import refuse_clash, slices, write_checkpoint

SPACE = "▁"
# How byte-level vocabularies split a text before they merge (a fixed value of that format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_BLANKS = re.compile(r"\s{10000}")  # the fast engine's splitter runs out of stack on much longer ones
# A text falls into parts before every space or newline that follows a visible character: no token of either side reaches across.
PARTS = re.compile(r"\s*\S+(?:[^\S \n]\s*(?:\S+|\Z))*|\s+")
PARTS_KEPT = 250_000  # that a worker remembers; affects speed only
SLICE = 1 << 20
CHUNK = 8192
FAN_IN = 32
LOAD = 1.5  # bits of a level for each key
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible ones stand for themselves, the rest follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """Two vocabularies: ``a`` is the JSON file of a byte-level BPE, ``b`` the bytes of a piece model."""

    a: str
    b: bytes
    bytes_a: list[bytes] = field(init=False)
    bytes_b: list[bytes] = field(init=False)

    def __post_init__(self) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = json.loads(self.a)
        letter = _byte_of_letter()
        vocabulary = spec["model"]["vocab"]
        self.special_a = special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens") or []}
        self.bytes_a = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for i, content in special.items():
            self.bytes_a[i] = content
        for token, i in vocabulary.items():
            if i not in special:
                self.bytes_a[i] = bytes(letter[c] for c in token)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies that leave the text as it is are supported")
        # The fast engine merges by ids; it may be used where ids follow the order of the merges.
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = [vocabulary[x + y] for x, y in merges]
        self.fast = made == sorted(made) and len(set(made)) == len(made) and spec["pre_tokenizer"].get("use_regex", True)
        model = proto.ModelProto()
        model.ParseFromString(self.b)
        kind = proto.ModelProto.SentencePiece.Type
        self.bytes_b = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        if not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only piece models that add one space and keep all others are supported")
        # Texts come with their space, and in parts; so the engine adds none.
        model.normalizer_spec.add_dummy_prefix = False
        self.plain_b = model.SerializeToString()
        inner = re.compile(rf"[^\s{SPACE}][ \n{SPACE}]")
        self.in_parts = not any(inner.search(p.piece) for p in model.pieces)
        self.name = hashlib.sha256(self.a.encode() + self.b).hexdigest()


def load(a: str, b: str) -> Tokenizers:
    """Read the two vocabulary files on the driver."""
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return Tokenizers(f.read(), g.read())


class Engines:
    """The two libraries' encoders and what both passes need, built once for each worker."""

    def __init__(self, vocabularies: Tokenizers) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        import tokenizers

        v = self.vocabularies = vocabularies
        self.slow = tokenizers.Tokenizer.from_str(v.a)
        self.slow.encode_special_tokens = True
        ranks = {t: i for i, t in enumerate(v.bytes_a) if t and i not in v.special_a}
        self.quick = tiktoken.Encoding(v.name[:8], pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if v.fast else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=v.plain_b)
        self.length_a = np.array([len(t) for t in v.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in v.bytes_b], np.int64)

    def encode_a(self, text: str) -> np.ndarray:
        if self.quick is not None and not LONG_BLANKS.search(text):
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def spelt(self, a: np.ndarray, b: np.ndarray, whole: bytes) -> bool:
        v = self.vocabularies
        return b"".join(map(v.bytes_a.__getitem__, a.tolist())) == whole == b"".join(map(v.bytes_b.__getitem__, b.tolist()))

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides of all parts end to end, and their numbers for each part; none where a side does not spell it."""
        none = np.zeros(0, np.int64)
        b = np.array(self.pieces.encode("".join(parts)), np.int64)
        a, data = self.encode_a("".join(parts)), [p.encode("utf-8") for p in parts]
        ends = np.cumsum(np.array([len(d) for d in data], np.int64))
        counts = []
        for side, length in ((a, self.length_a), (b, self.length_b)):
            at = np.cumsum(length[side])
            upto = np.searchsorted(at, ends, side="right")
            if len(side) and np.array_equal(at[upto - 1], ends):
                counts.append(np.diff(upto, prepend=0))
        if len(counts) == 2 and self.spelt(a, b, b"".join(data)):
            return a, b, *counts
        if len(parts) > 1:  # the fault is in one half, or they do not go together
            halves = [self.encode(parts[:len(parts) // 2]), self.encode(parts[len(parts) // 2:])]
            return tuple(np.concatenate(x) for x in zip(*halves))
        return none, none, np.zeros(1, np.int64), np.zeros(1, np.int64)

    def parts(self, text: str) -> list[str]:
        return PARTS.findall(text) if self.vocabularies.in_parts else [text]


ENGINES: dict[str, Engines] = {}


def engines(vocabularies: Tokenizers) -> Engines:
    if vocabularies.name not in ENGINES:
        ENGINES.clear()
        ENGINES[vocabularies.name] = Engines(vocabularies)
    return ENGINES[vocabularies.name]


class Aligned:
    """The parts a worker has aligned, by number: tokens of each side, linked pairs, and the groups as text."""

    def __init__(self, engine: Engines, written: bool) -> None:
        self.engine = engine
        self.table = _id_texts(len(engine.length_a), len(engine.length_b)) if written else None
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.n_a, self.n_b, self.n_pairs = (np.zeros(0, np.int64) for _ in range(3))
        self.spelt = np.zeros(0, bool)
        self.pairs = np.zeros(0, np.int64)  # of all parts end to end
        self.groups: list[str] = []

    def add(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all parts of these texts end to end, and how many each text has."""
        split = [self.engine.parts(" " + t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(p for s in split for p in s if p not in self.number))
        if fresh:
            self._align(fresh)
        counts = np.array([len(s) for s in split], np.int64)
        return np.fromiter((self.number[p] for s in split for p in s), np.int64, int(counts.sum())), counts

    def _align(self, parts: list[str]) -> None:
        engine = self.engine
        # What ends in a blank is encoded alone, else it would meet the blank after it.
        ends_blank = [p for p in parts if p[-1].isspace()]
        parts = [*[p for p in parts if not p[-1].isspace()], *ends_blank]
        together = [parts[:len(parts) - len(ends_blank)], *[[p] for p in ends_blank]]
        a, b, count_a, count_b = (np.concatenate(x) for x in zip(*[engine.encode(t) for t in together if t]))
        ends_a, ends_b = np.cumsum(engine.length_a[a]), np.cumsum(engine.length_b[b])
        size = int(ends_a[-1]) + 1 if len(a) else 1
        in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
        in_a[ends_a], in_b[ends_b] = True, True
        last_a, last_b = in_b[ends_a], in_a[ends_b]  # the tokens that end a group
        upto = np.append(0, np.cumsum(last_a))
        ends = upto[np.cumsum(count_a)]
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts))))
        self.n_a, self.n_b = np.concatenate([self.n_a, count_a]), np.concatenate([self.n_b, count_b])
        self.n_pairs = np.concatenate([self.n_pairs, np.diff(ends, prepend=0)])
        self.spelt = np.concatenate([self.spelt, count_a > 0])
        self.pairs = np.concatenate([self.pairs, a[last_a] * len(engine.length_b) + b[last_b]])
        if self.table is not None:
            self.groups += self._texts(a, b, last_a, last_b, count_a + count_b)

    def _texts(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, counts: np.ndarray) -> list[str]:
        """The groups of each part: the ids of both sides take their places, group by group, and bring their mark with them."""
        size_a, size_b, groups = len(self.engine.length_a), len(self.engine.length_b), int(last_a.sum())
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        of_a, of_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        codes = np.zeros(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]] = a + last_a * size_a
        codes[np.arange(len(b)) + np.cumsum(of_a)[group_b]] = b + last_b * size_b + 2 * size_a
        ends = np.cumsum(counts).tolist()
        return ["".join(map(self.table.__getitem__, codes[i:j].tolist()))[:-1] for i, j in zip([0, *ends[:-1]], ends)]


def _id_texts(size_a: int, size_b: int) -> list[str]:
    """Ids with what follows them: a comma inside a side, a bar after the last of ``a``, a semicolon after the last of ``b``."""
    return [f"{i}{mark}" for size, marks in ((size_a, ",|"), (size_b, ",;")) for mark in marks for i in range(size)]


def whole_texts(spelt: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which texts have parts and only such as both sides spell."""
    return (counts > 0) & (per_text(~spelt, counts) == 0)


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over the parts of each text."""
    sums, ends = np.append(0, np.cumsum(values)), np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def most_pairs(v: Tokenizers) -> int:
    """How many pairs of tokens end alike: the most that any collection can link."""
    ids_a, ids_b = Counter(t for t in v.bytes_a if t), Counter(t for t in v.bytes_b if t)
    endings = sum(n * ids_b[t[i:]] for t, n in ids_a.items() for i in range(len(t)))
    return endings + sum(n * ids_a[t[i:]] for t, n in ids_b.items() for i in range(1, len(t)))


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct keys to the numbers from 0 on, without gaps; other keys get any of these or -1."""

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # bits, words, ones before each word
        rest, placed = np.asarray(keys, np.int64), 0
        if len(np.unique(rest)) != len(rest):
            raise ValueError("keys are repeated")
        while len(rest):
            bits = max(64, int(len(rest) * LOAD))
            at = (_spread(rest, len(self.levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            words = np.zeros(-(-bits // 64), np.uint64)
            ones = np.flatnonzero(alone)
            np.bitwise_or.at(words, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
            per_word = np.bitwise_count(words).astype(np.int64)
            self.levels.append((bits, words, placed + np.cumsum(per_word) - per_word))
            placed += len(ones)
            rest = rest[~alone[at]]
        self.size = placed

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, words, before) in enumerate(self.levels):
            if not len(left):
                break
            at = (_spread(keys[left], level) % np.uint64(bits)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            under = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (before[at >> 6] + under)[hit]
            left = left[~hit]
        return out


@dataclass
class Links:
    """Every linked pair of a collection with its count, by perfect hash."""

    place: PerfectHash
    keys: np.ndarray
    counts: np.ndarray
    size_b: int

    def __post_init__(self) -> None:
        best = np.zeros(self.size_b, np.int64)
        np.maximum.at(best, self.keys % self.size_b, self.counts)
        self.is_best = self.counts == best[self.keys % self.size_b]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands; -1 for one that is not there."""
        at = self.place(keys)
        return np.where((at >= 0) & (self.keys[at] == keys), at, -1) if len(self.keys) else at

    def table(self, spark: SparkSession) -> DataFrame:
        """``a, b, links, best``: each pair once."""
        return spark.createDataFrame(pa.table({"a": self.keys // self.size_b, "b": self.keys % self.size_b, "links": self.counts, "best": self.is_best}))


def task_pairs(docs: DataFrame, vocabularies: Tokenizers, text: str = "text") -> DataFrame:
    """``pair, n``: the distinct pairs of each task with their number of links in its documents."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        known, used = Aligned(engines(sent.value), written=False), np.zeros(0, np.int64)

        def counted() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([keys, known.pairs])
            n = np.concatenate([counts, np.repeat(used, known.n_pairs)])
            merged, where = np.unique(every, return_inverse=True)
            total = np.zeros(len(merged), np.int64)
            np.add.at(total, where, n)
            return merged[total > 0], total[total > 0]

        for whole in batches:
            for batch in slices(whole, 0, SLICE):
                numbers, sizes = known.add(batch.column(0).to_pylist())
                good = np.repeat(whole_texts(known.spelt[numbers], sizes), sizes)
                more = np.bincount(numbers[good], minlength=len(known.number))
                more[:len(used)] += used
                used = more
                if len(used) > PARTS_KEPT:
                    keys, counts = counted()
                    known.clear()
                    used = np.zeros(0, np.int64)
        keys, counts = counted()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    return docs.select(text).mapInArrow(run, "pair long, n long")


def tree_sum(pairs: DataFrame, place: PerfectHash) -> np.ndarray:
    """The numbers of all tasks by hash value: an array a task, added ``FAN_IN`` at a time."""
    sent = pairs.sparkSession.sparkContext.broadcast(place)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        total = np.zeros(-(-place.size // CHUNK) * CHUNK, np.int64)
        for batch in batches:
            np.add.at(total, place(batch.column(0).to_numpy(zero_copy_only=False)), batch.column(1).to_numpy(zero_copy_only=False))
        rows = [(c, total[c * CHUNK:(c + 1) * CHUNK].tobytes()) for c in range(len(total) // CHUNK)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(rows), pa.int64()), pa.array([c for c, _ in rows], pa.int64()),
                                          pa.array([v for _, v in rows], pa.binary())], names=["part", "chunk", "counts"])

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for value in group.column("counts"):
            total += np.frombuffer(value.as_py(), np.int64)
        return pa.table({"part": group.column("part").slice(0, 1), "chunk": group.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part long, chunk long, counts binary"
    arrays, parts = pairs.mapInArrow(dense, schema), pairs.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        arrays = arrays.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part", "chunk").applyInArrow(added, schema)
    out = np.zeros(-(-place.size // CHUNK) * CHUNK, np.int64)
    for row in arrays.collect():  # one array, as long as there are pairs
        out[row.chunk * CHUNK:(row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, np.int64)
    return out[:place.size]


def count_links(docs: DataFrame, vocabularies: Tokenizers, text: str = "text") -> Links:
    """First pass: the pairs of all documents and their counts."""
    pairs = write_checkpoint(task_pairs(docs, vocabularies, text))
    found = pairs.select("pair").distinct().toArrow().column(0).to_numpy()  # at most ``most_pairs``
    place = PerfectHash(found)
    keys = np.zeros(place.size, np.int64)
    keys[place(found)] = found
    return Links(place, keys, tree_sum(pairs, place), len(vocabularies.bytes_b))


def aligned(docs: DataFrame, vocabularies: Tokenizers, links: Links, text: str = "text", groups: str | None = None) -> DataFrame:
    """Second pass: ``docs`` with the numbers of tokens, groups and links, of links that are best for their second id, the sum of the links'
    counts, and a hash of the groups; ``groups`` names a column for the groups themselves."""
    refuse_clash(docs, *NUMBERS, "groups_sha256", *[groups] * (groups is not None))
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast((vocabularies, links))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies, links = sent.value
        known = Aligned(engines(vocabularies), written=True)
        best, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each part
        for whole in batches:
            for batch in slices(whole, at, SLICE):
                if len(known.number) > PARTS_KEPT:
                    known.clear()
                    best, sums = best[:0], sums[:0]
                old = len(known.number), len(known.pairs)
                numbers, counts = known.add(batch.column(at).to_pylist())
                if len(known.number) > old[0]:
                    found, n = links.find(known.pairs[old[1]:]), known.n_pairs[old[0]:]
                    # -1 only in parts of texts that do not count, as another part of theirs is not spelt.
                    best = np.concatenate([best, per_text(np.where(found < 0, 0, links.is_best[found]), n)])
                    sums = np.concatenate([sums, per_text(np.where(found < 0, 0, links.counts[found]), n)])
                good = whole_texts(known.spelt[numbers], counts)
                columns = [np.where(good, per_text(x[numbers], counts), 0) for x in (known.n_a, known.n_b, known.n_pairs, known.n_pairs, best, sums)]
                ends = np.cumsum(counts).tolist()
                numbers = numbers.tolist()
                strings = [";".join(map(known.groups.__getitem__, numbers[i:j])) if g else "" for g, i, j in zip(good, [0, *ends[:-1]], ends)]
                hashes = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in strings]
                more = [] if groups is None else [pa.array(strings, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in columns], pa.array(hashes, pa.string()), *more],
                                                 names=[*batch.schema.names, *NUMBERS, "groups_sha256", *[groups] * len(more)])

    fields = [*[StructField(c, LongType()) for c in NUMBERS], *[StructField(c, StringType()) for c in ("groups_sha256", groups) if c]]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields]))
