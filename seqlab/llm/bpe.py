"""Byte-level BPE by Aho-Corasick matching and backtracking.

The vocabulary's byte strings, read as Latin-1, form one automaton that gives the longest token ending at every
place. A piece is encoded from left to right: take the longest token that fits, and step back to a shorter one when
the last two tokens could not stand side by side, that is, when merging their joint bytes by rank gives other tokens.
That test depends on the two tokens alone and is memoised; each place is tried once, so the time is linear.

Edge cases: null and empty texts have no ids; texts of any length are encoded whole; repeated rows are encoded row by
row; rows with a null id keep it; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, free_name

#: Pieces, and pairs of tokens, of a generation of a Python worker's memory; the one before is kept as well.
MEMORY = 150_000
_NOTHING = (-1, (0, None))


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            text = token.decode("latin-1")
            self.automaton.add_word(text, (len(text), ranks[token]))
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.old_fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.old_pieces: dict[str, tuple[int, ...]] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a token that no merge makes."""
        if token not in self.parts:
            whole = self.bytes_of[token]
            self.parts[token] = None
            for i in range(1, len(whole)):
                a, b = self.ranks.get(whole[:i]), self.ranks.get(whole[i:])
                if a is not None and b is not None and max(a, b) < token and self.compatible(a, b, token):
                    self.parts[token] = a, b
                    break
        return self.parts[token]

    def compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether left and right stay as they are side by side. limit: only merges of lower rank count."""
        key = (left, right)
        if limit is None:
            known = self.fits.get(key)
            if known is not None:
                return known
            known = self.old_fits.get(key)
            if known is not None:
                return self.remember(key, known)
        a, b, bound, good = left, right, limit if limit is not None else 1 << 62, True
        while True:
            joint = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joint is not None and joint < bound:
                good = False
                break
            # undo the younger of the two; the merge across the border must come before it to matter
            of_a, of_b = self.split(a), self.split(b)
            if of_a is None and of_b is None:
                break
            if of_b is None or (of_a is not None and a > b):
                bound = min(bound, a)
                a = of_a[1]
            else:
                bound = min(bound, b + 1)
                b = of_b[0]
        return self.remember(key, good) if limit is None else good

    def remember(self, key: tuple[int, int], good: bool) -> bool:
        if len(self.fits) >= MEMORY:
            self.fits, self.old_fits = {}, self.fits
        self.fits[key] = good
        return good

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece of text."""
        raw = text.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        return tuple(self.backtrack(raw))

    def backtrack(self, raw: bytes) -> list[int]:
        n, text, matches = len(raw), raw.decode("latin-1"), self.automaton.iter_long
        ids: list[int] = []
        dead: set[int] = set()  # places from which nothing leads to the end
        at, (end, (size, token)) = 0, next(matches(text, 0), _NOTHING)
        while at < n:
            if end != at + size - 1:
                token = None
            while token is not None and (at + size in dead or (ids and not self.compatible(ids[-1], token))):
                size, token = self.shorter(raw, at, size - 1)
            if token is not None:
                ids.append(token)
                at += size
                if at < n:
                    end, (size, token) = next(matches(text, at), _NOTHING)
            elif ids:
                dead.add(at)
                last = len(self.bytes_of[ids.pop()])
                at -= last
                size, token = self.shorter(raw, at, last - 1)
                end = at + size - 1
            else:
                raise ValueError("the vocabulary cannot encode these bytes")
        return ids

    def shorter(self, raw: bytes, at: int, size: int) -> tuple[int, int | None]:
        """The size and the longest token of at most size bytes that begins at this place."""
        while size > 0:
            token = self.ranks.get(raw[at : at + size])
            if token is not None:
                break
            size -= 1
        else:
            token = None
        return size, token

    def encode(self, text: str) -> list[int]:
        """As the rank merges give, piece by piece."""
        known, out = self.pieces, []
        for piece in self.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.old_pieces.get(piece) or self.piece(piece)
                if len(piece) < 64:
                    if len(known) >= MEMORY:
                        self.old_pieces, known = known, {}
                        self.pieces = known
                    known[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file (base64 of the token, space, rank), read on the driver's machine; its size is the vocabulary's."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


#: Automata that this Python worker has built, by vocabulary.
_BUILT: dict[str, Bpe] = {}


class _Shared:
    """A broadcast vocabulary; equal keys share the automaton that a worker has built."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        bounded_batches(spark)
        ranks = read_ranks(spark, path)
        self.key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
        self.value = spark.sparkContext.broadcast((ranks, pattern))

    def bpe(self) -> Bpe:
        found = _BUILT.get(self.key)
        if found is None:
            _BUILT.clear()
            found = _BUILT[self.key] = Bpe(*self.value.value)
        return found


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of docs, whose text is encoded whole, and ids array<int> (ids_ and so on if docs has that)."""
    shared = _Shared(docs.sparkSession, path, pattern)

    @F.pandas_udf("array<int>")
    def ids(texts):
        bpe = shared.bpe()
        return texts.map(lambda t: bpe.encode(t or ""))

    return docs.withColumn(free_name("ids", docs.columns), ids("text"))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns of tokens and bytes binary (bytes_ and so on if tokens has that), the bytes of its ids."""
    shared = _Shared(tokens.sparkSession, path, pattern)

    @F.pandas_udf("binary")
    def back(rows):
        bpe = shared.bpe()
        return rows.map(lambda x: bpe.decode(list(map(int, x))))

    return tokens.withColumn(free_name("bytes", tokens.columns), back(ids))


def digest_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes decoded from the ids).

    Encodes and decodes in one pass over the rows, without a shuffle; the ids themselves don't leave the task.
    """
    shared = _Shared(docs.sparkSession, path, pattern)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.bpe()
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digests, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of docs but text, and ids array<int>, n_tokens, intact (whether the ids decode to the text's bytes), in one pass.

    A name that docs has already gets an underscore at its end.
    """
    shared = _Shared(docs.sparkSession, path, pattern)
    rest = [c for c in docs.columns if c != "text"]
    names = [free_name(c, rest) for c in ("ids", "n_tokens", "intact")]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest]

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.bpe()
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [bpe.encode(t) for t in texts]
                intact = [bpe.decode(x) == t.encode() for x, t in zip(ids, texts)]
                columns = [*(part.column(c) for c in rest), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array(intact)]
                yield pa.RecordBatch.from_arrays(columns, [*rest, *names])

    return docs.select(*rest, "text").mapInArrow(tokens, ", ".join([*fields, f"`{names[0]}` array<int>, `{names[1]}` long, `{names[2]}` boolean"]))
