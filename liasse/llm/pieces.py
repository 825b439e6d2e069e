"""SentencePiece encoding and decoding with batched numpy Viterbi.

Words of equal length advance together.  At each end position the hashes of all
substrings that end there probe the sorted keys of the pieces; of the pieces
found, the best one that may follow the token before it is stored as the
backpointer.

What "may follow" and "best" mean depends on the model's kind.  For a unigram
model each pair may follow and the best sum of scores wins: plain Viterbi.  For
a BPE model scores are merge ranks and their sum means nothing; there a token
may follow another only if the merges inside both come before every merge across
their border.  Each prefix of a word then has exactly one such path, and it is
the one that merging gives.  So both kinds give the library's own ids.

A null text has null ids, an empty one none.  Characters without a piece become
byte pieces where the model has them, else the unknown id.  Repeated rows are
encoded one by one and alike; the other columns pass through.  Texts are encoded
whole, however long.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

SPACE = "▁"
ROOT = np.uint64(0x9E3779B97F4A7C15)
WORDS_KEPT = 250_000  # encoded words that a worker remembers; affects speed only
DOCS_AT_ONCE = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """Spread numbers over 64 bits."""
    x = x.astype(np.uint64) + ROOT
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Model:
    """A model's pieces as arrays; an id of ``len(pieces)`` stands for a character without a piece."""

    pieces: list[str]
    score: np.ndarray
    is_bpe: bool
    unk: int
    bytes_of: dict[int, int]  # byte -> id
    plain: np.ndarray  # pieces that text can be cut into
    dummy_prefix: bool
    squeeze: bool

    def __post_init__(self) -> None:
        with np.errstate(over="ignore"):  # hashes wrap around
            self._hashes()
        if self.is_bpe:
            self._spines()

    def _hashes(self) -> None:
        n = len(self.pieces)
        self.length = np.array([len(p) for p in self.pieces] + [1], np.int64)
        self.longest = int(self.length[:-1][self.plain].max(initial=1))
        self.powers = np.ones(self.longest + 2, np.uint64)
        for i in range(1, len(self.powers)):
            self.powers[i] = self.powers[i - 1] * ROOT
        self.hash = np.zeros(n + 1, np.uint64)
        for i, p in enumerate(self.pieces):
            if self.plain[i]:
                h = np.uint64(0)
                for c in mix(codes(p)):
                    h = h * ROOT + c
                self.hash[i] = h
        known = np.flatnonzero(self.plain)
        known = known[np.argsort(self.hash[known])]
        self.keys, self.ids = self.hash[known], known
        self.seen = np.zeros(1 << 20, bool)  # leading bits of the keys: most substrings end here
        self.seen[self.keys >> np.uint64(44)] = True
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        long_pieces = "".join(p for i, p in enumerate(self.pieces) if self.plain[i] and len(p) > 1)
        self.newline_alone = "\n" not in long_pieces
        self.no_inner_space = not any(SPACE in p.lstrip(SPACE) for i, p in enumerate(self.pieces) if self.plain[i])

    def _spines(self) -> None:
        """The two halves of each piece's last merge, and which pieces merging can make at all."""
        n = len(self.pieces)
        self.left, self.right = np.full(n + 1, -1), np.full(n + 1, -1)
        self.rank = np.append(-self.score, -np.inf)
        self.made = self.plain.copy()
        where = {p: i for i, p in enumerate(self.pieces) if self.plain[i]}
        self.where = where
        for i in np.flatnonzero(self.plain):
            p = self.pieces[i]
            if len(p) == 1:
                self.rank[i] = -np.inf
                continue
            out, last = merge(p, where, self.score)
            if out == [p]:
                self.left[i], self.right[i] = (where.get(x, n) for x in last)
            else:
                self.made[i] = False

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.seen[h >> np.uint64(44)])
        wanted = h[maybe]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        out[maybe[hit]] = self.ids[at[hit]]
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of tokens ``a`` and ``b`` gives just these two.

        Go back in time from the whole tokens: the half that was made last is
        taken apart, and what then stood at the border must not have merged
        across it before that half was made.  At equal rank the left one merges first.
        """
        fine = np.ones(len(a), bool)
        rows = np.arange(len(a))
        x, y, limit, strict = a.copy(), b.copy(), np.full(len(a), np.inf), np.zeros(len(a), bool)
        while len(rows):
            joined = self.length[x] + self.length[y]
            h = self.hash[x] * self.powers[np.minimum(self.length[y], self.longest)] + self.hash[y]
            n = len(self.pieces)
            across = np.where((joined <= self.longest) & (x != n) & (y != n), self.find(h), -1)
            r = np.where(across >= 0, self.rank[across], np.inf)
            bad = (across >= 0) & np.where(strict, r < limit, r <= limit)
            fine[rows[bad]] = False
            first = self.rank[x] > self.rank[y]
            limit = np.where(first, self.rank[x], self.rank[y])
            strict = first
            x2, y2 = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
            on = ~bad & (x2 >= 0) & (y2 >= 0)
            rows, x, y, limit, strict = rows[on], x2[on], y2[on], limit[on], strict[on]
        return fine


def merge(word: str, where: dict[str, int], score: np.ndarray) -> tuple[list[str], tuple[str, str]]:
    """The pieces that merging gives, best score first and left before right; and the last merge."""
    parts: list[str | None] = list(word)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    last = ("", "")
    heap = [(-score[where[word[i:i + 2]]], i, word[i], word[i + 1]) for i in range(len(word) - 1) if word[i:i + 2] in where]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        last, parts[i], parts[j], after[i] = (a, b), a + b, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for s, t in ((before[i], i), (i, after[i])):
            if s >= 0 and t < len(parts) and parts[s] + parts[t] in where:
                heapq.heappush(heap, (-score[where[parts[s] + parts[t]]], s, parts[s], parts[t]))
    return [p for p in parts if p is not None], last


def load(path: str) -> Model:
    """Read a model file on the driver; its size is that of a vocabulary."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap:
        raise ValueError("models that rewrite characters are not supported")
    kind = proto.ModelProto.SentencePiece.Type
    types = np.array([p.type for p in m.pieces])
    return Model(
        pieces=[p.piece for p in m.pieces], score=np.array([p.score for p in m.pieces]), is_bpe=m.trainer_spec.model_type == proto.TrainerSpec.BPE,
        unk=int(np.flatnonzero(types == kind.UNKNOWN)[0]), bytes_of={int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kind.BYTE},
        plain=np.isin(types, (kind.NORMAL, kind.USER_DEFINED)), dummy_prefix=m.normalizer_spec.add_dummy_prefix,
        squeeze=m.normalizer_spec.remove_extra_whitespaces)


def normalised(model: Model, text: str) -> str:
    if model.squeeze:
        text = re.sub(" +", " ", text).strip(" ")
    if not text:
        return ""
    return (SPACE if model.dummy_prefix else "") + text.replace(" ", SPACE)


def cut(model: Model, text: str) -> list[str]:
    """Words between which no piece reaches."""
    if not model.no_inner_space:
        return [text] if text else []
    if not model.newline_alone:
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", text)
    return re.findall(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+", text)


def viterbi(model: Model, words: list[str]) -> np.ndarray:
    """Token ids of words of one length, a row for each with -1 in unused places; ``len(pieces)`` marks a character without a piece."""
    n, size, none = len(words), len(words[0]), len(model.pieces)
    letters = mix(codes("".join(words)).reshape(n, size))
    prefix = np.zeros((size + 1, n), np.uint64)
    for j in range(size):
        prefix[j + 1] = prefix[j] * ROOT + letters[:, j]
    token = np.full((size + 1, n), -1, np.int64)  # the one that ends here
    best = np.full((size + 1, n), -np.inf)
    best[0] = 0
    usable = np.append(model.made if model.is_bpe else model.plain, False)
    floor = model.score[model.plain].min(initial=0.0) - 10.0
    for j in range(1, size + 1):
        rows = np.arange(n)  # without a token that ends here yet; unigram models look at all
        for k in range(min(j, model.longest), 0, -1):
            i = j - k
            if not len(rows):
                break
            found = model.find(prefix[j, rows] - prefix[i, rows] * model.powers[k])
            if k == 1:
                fits = np.arange(len(rows))
                found[(found < 0) | ~usable[found]] = none
            else:
                fits = np.flatnonzero((found >= 0) & usable[found])
            if not len(fits):
                continue
            at, ids = rows[fits], found[fits]
            if model.is_bpe:
                before = token[i, at]
                good = np.ones(len(at), bool) if i == 0 else before >= 0
                if i:
                    good[good] = model.may_follow(before[good], ids[good])
                token[j, at[good]] = ids[good]
                taken = np.zeros(len(rows), bool)
                taken[fits[good]] = True
                rows = rows[~taken]
            else:
                value = best[i, at] + np.where(ids == none, floor, model.score[np.minimum(ids, none - 1)])
                better = value > best[j, at]
                best[j, at[better]], token[j, at[better]] = value[better], ids[better]
    # Follow the backpointers of all words together.
    end, out = np.full(n, size), np.full((n, size), -1, np.int64)
    for at in range(size):
        live = np.flatnonzero(end > 0)
        if not len(live):
            break
        last = token[end[live], live]
        out[live, size - 1 - at] = last
        end[live] -= model.length[last]
    return out


class Encoded:
    """Words a worker has encoded: their ids end to end, with each word's start and number."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, words: list[str], counts: np.ndarray, flat: np.ndarray) -> None:
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        starts = len(self.flat) + np.cumsum(counts) - counts
        self.start, self.count = np.concatenate([self.start, starts]), np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these words end to end, and where each word's end."""
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        counts = self.count[at]
        ends = np.cumsum(counts)
        places = np.repeat(self.start[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[places], ends


def encode_words(model: Model, words: list[str], into: Encoded) -> None:
    by_length: dict[int, list[str]] = {}
    odd: dict[str, np.ndarray] = {}
    none = len(model.pieces)
    for w in words:
        if model.is_bpe and SPACE * 2 in w:  # runs of blanks share one rank, so the order of merging has to be played out
            odd[w] = np.array([model.where.get(p, none) for p in merge(w, model.where, model.score)[0]], np.int64)
        else:
            by_length.setdefault(len(w), []).append(w)
    for group in by_length.values():
        for start in range(0, len(group), 20_000):
            part = group[start:start + 20_000]
            ids = viterbi(model, part)
            strange = (ids == none).any(axis=1)
            odd.update((part[r], ids[r][ids[r] >= 0]) for r in np.flatnonzero(strange))
            ids = ids[~strange]
            used = ids >= 0
            into.add([w for w, x in zip(part, strange.tolist()) if not x], used.sum(axis=1), ids[used])
    full = {w: _without_piece(model, w, ids) if (ids == none).any() else ids for w, ids in odd.items()}
    if full:
        into.add(list(full), np.array([len(x) for x in full.values()], np.int64), np.concatenate(list(full.values())))


def _without_piece(model: Model, word: str, ids: np.ndarray) -> np.ndarray:
    """Bytes, or one unknown id for a run, in place of characters without a piece."""
    out: list[int] = []
    at, none, before = 0, len(model.pieces), -1
    for t in ids.tolist():
        if t != none:
            out.append(t)
        elif model.bytes_of:
            out += [model.bytes_of[b] for b in word[at].encode("utf-8", "replace")]
        elif before != none:
            out.append(model.unk)
        before = t
        at += int(model.length[t])
    return np.array(out, np.int64)


def encode_batch(model: Model, texts: list[str | None], memory: Encoded) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, and where each text's end; a null text has none."""
    split = [[] if t is None else cut(model, normalised(model, t)) for t in texts]
    words = [w for s in split for w in s]
    fresh = set(words) - memory.at.keys()
    if len(memory.at) + len(fresh) > WORDS_KEPT:
        memory.clear()
        fresh = set(words)
    encode_words(model, list(fresh), memory)
    flat, ends = memory.ids(words)
    n = np.cumsum([len(s) for s in split])
    return flat, np.append(0, ends)[n]


def decode_ids(model: Model, ids: np.ndarray, table: list[bytes]) -> str:
    text = b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def byte_table(model: Model) -> list[bytes]:
    table = [p.encode() if ok else b"" for p, ok in zip(model.pieces, model.plain)]
    for b, i in model.bytes_of.items():
        table[i] = bytes([b])
    table[model.unk] = " ⁇ ".encode()
    return table


def encode(df: DataFrame, model: Model, text: str = "text", ids: str = "ids", round_trip: str | None = None) -> DataFrame:
    """``df`` with the ids of each whole text; an existing column of that name is replaced.

    ``round_trip`` names a column for whether decoding the ids gives the text back.
    """
    kept = [c for c in df.columns if c not in (ids, round_trip)]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, table = Encoded(), byte_table(model)
        for whole in batches:
            for start in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(start, DOCS_AT_ONCE)
                texts = batch.column(at).to_pylist()
                values, ends = encode_batch(model, texts, memory)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values), mask=batch.column(at).is_null())
                more = [] if round_trip is None else [pa.array(
                    [t is None or decode_ids(model, values[i:j], table) == t for t, i, j in zip(texts, [0, *ends[:-1].tolist()], ends.tolist())], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, *more], names=[*batch.schema.names, ids, *[round_trip] * len(more)])

    checked = [] if round_trip is None else [StructField(round_trip, BooleanType())]
    schema = StructType([*df.select(*kept).schema.fields, StructField(ids, ArrayType(IntegerType())), *checked])
    return df.select(*kept).mapInArrow(run, schema)


def decode(df: DataFrame, model: Model, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids spell; null ids give null."""
    kept = [c for c in df.columns if c != text]
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(model)
        for whole in batches:
            for start in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(start, DOCS_AT_ONCE)
                lists = batch.column(at)
                texts = [None if not x.is_valid else decode_ids(model, x.values.to_numpy(zero_copy_only=False), table) for x in lists]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    schema = StructType([*df.select(*kept).schema.fields, StructField(text, StringType())])
    return df.select(*kept).mapInArrow(run, schema)
