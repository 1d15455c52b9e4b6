"""Byte-level byte-pair encoding and decoding with a queue of merge ranks.

A text is cut into pieces by a pattern; every piece is merged on its own, lowest rank first and the
leftmost place among equal ranks. Many pieces are merged at once: their places form one linked list
that no pair crosses from piece to piece, and a queue holds the places in a bucket per rank. Which
buckets hold places is marked in bitmaps, a bit of a word standing for a word of the level below, so
the next rank is found by a find-first-set a level. A merge doesn't remove the entries it outdates;
they are skipped when they come up. A piece of n bytes costs n log n whatever its length. Pieces met
before are remembered, up to a bound.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kerbside.llm.common import in_arrow
from kerbside.llm.packing import PATTERN

WORD_BITS = 6  # a bitmap word covers 64 entries of the level below
REMEMBERED = 1 << 18  # pieces of a generation; a worker remembers two
SHORT = 48  # characters of the longest piece that is remembered
LONG_TEXT = 1 << 20  # characters from which a text's pieces are taken in runs
RUN = 1 << 17  # pieces looked up at once
MERGED_BYTES = 1 << 20  # of pieces merged at once, or one longer piece
_OUTPUT_CHARS = 1 << 22  # about as many characters a batch of output


class RankQueue:
    """Places by rank, the lowest rank first."""

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        size = ranks
        while size > 1 or not self.levels:
            size = -(-size >> WORD_BITS) or 1
            self.levels.append([0] * size)
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, places: list[int]) -> None:
        """Queue places, keeping the given list."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += places
            return
        self.buckets[rank] = places
        at = rank
        for level in self.levels:
            at, bit = at >> WORD_BITS, 1 << (at & (1 << WORD_BITS) - 1)
            marked = level[at]
            level[at] = marked | bit
            if marked:  # the levels above know of this word
                break

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its places from left to right, or None from an empty queue."""
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            if not word:
                return None
            rank = rank << WORD_BITS | (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            at, bit = at >> WORD_BITS, 1 << (at & (1 << WORD_BITS) - 1)
            level[at] ^= bit
            if level[at]:
                break
        places = self.buckets.pop(rank)
        places.sort()
        return rank, places


class _Bytes(dict):
    """Bytes of an id; none for an id the vocabulary hasn't."""

    def __missing__(self, token: int) -> bytes:
        return b""


class Codec:
    """Ids of whole texts and back, by a file of ranks (base64 bytes and rank a line)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes_of = _Bytes((rank, token) for token, rank in self.ranks.items())
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.of_pair = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.known: dict[str, bytes] = {}  # ids of pieces met lately, and
        self.older: dict[str, bytes] = {}  # before them

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each piece; no piece is empty."""
        data, rank_of, queue = b"".join(pieces), self.ranks.get, self.queue
        buckets, n = queue.buckets, len(data)
        starts = np.cumsum([0, *map(len, pieces)])
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        pair = np.append(self.of_pair[raw[:-1] << 8 | raw[1:]], -1)
        pair[starts[1:] - 1] = -1
        order = np.argsort(pair, kind="stable")
        groups = np.flatnonzero(np.diff(pair[order], prepend=-1))
        for a, b in zip(groups.tolist(), [*groups[1:].tolist(), n]):
            queue.put(int(pair[order[a]]), order[a:b].tolist())
        first = bytearray(n + 1)  # whether a piece starts here
        for at in starts.tolist():
            first[at] = 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at, token, alive = pair.tolist(), self.of_byte[raw].tolist(), bytearray(b"\1") * n
        while (found := queue.pop()) is not None:
            rank, places = found
            for done, i in enumerate(places, 1):
                if rank_at[i] != rank:
                    continue  # stale: the pair was merged or has grown
                gone = after[i]
                rank_at[gone], alive[gone], token[i] = -1, 0, rank
                after[i] = end = after[gone]
                lowest = rank
                rank_at[i] = -1
                if not first[end]:
                    before[end] = i
                    rank_at[i] = new = rank_of(data[i:after[end]], -1)
                    if new >= 0:
                        lowest = new if new < lowest else lowest
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            queue.put(new, [i])
                if not first[i]:
                    left = before[i]
                    rank_at[left] = new = rank_of(data[left:end], -1)
                    if new >= 0:
                        lowest = new if new < lowest else lowest
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            queue.put(new, [left])
                if lowest < rank and done < len(places):  # a lower rank came up: the rest has to wait
                    queue.put(rank, places[done:])
                    break
        left_over = np.frombuffer(alive, np.uint8).astype(bool)
        ids = np.array(token, "<u4")[left_over].tobytes()
        ends = (4 * np.cumsum(np.add.reduceat(left_over.astype(np.int64), starts[:-1]))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't remembered."""
        out, held, size = {}, [], 0
        todo = iter(pieces)
        while True:
            piece = next(todo, None)
            if held and (piece is None or size >= MERGED_BYTES):
                out.update(zip(held, self.merge([p.encode() for p in held])))
                held, size = [], 0
            if piece is None:
                return out
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is None:
                held.append(piece)
                size += len(raw)
            else:
                out[piece] = whole.to_bytes(4, "little")

    def _runs(self, texts: list[str]) -> Iterator[list[tuple[int, list[str]]]]:
        """Bounded runs of (number of the text, some of its pieces)."""
        run, size = [], 0
        for number, text in enumerate(texts):
            if len(text) < LONG_TEXT:
                lists = iter([self.pattern.findall(text)])
            else:
                pieces = (m.group() for m in self.pattern.finditer(text))
                lists = iter(lambda: list(islice(pieces, RUN)), [])
            for some in lists:
                run.append((number, some))
                size += len(some)
                if size >= RUN:
                    yield run
                    run, size = [], 0
        if run:
            yield run

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of whole texts."""
        out: list[list[bytes]] = [[] for _ in texts]
        for run in self._runs(texts):
            wanted = set().union(*(some for _, some in run))
            unknown = wanted - self.known.keys()
            again = {p: self.older[p] for p in unknown & self.older.keys()}
            have, fresh = self.known, self._learn(unknown - again.keys())
            have.update(again)
            have.update(fresh)
            for number, some in run:
                out[number].append(b"".join(map(have.__getitem__, some)))
            for long in [p for p in fresh if len(p) > SHORT]:
                del have[long]
            if len(have) > REMEMBERED:  # what isn't met again goes with the next generation
                self.older, self.known = have, {}
        return [np.frombuffer(b"".join(ids), "<u4") for ids in out]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str = PATTERN) -> Codec:
    """The codec of this worker."""
    return Codec(path, pattern)


def _lists(runs: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
    flat = np.concatenate([*runs, np.zeros(0, "<u4")]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, back: bool) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_tokens", "input_ids", *["decoded"] * back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            first, texts, size = 0, [], 0
            for row in range(batch.num_rows):
                texts.append(batch.column(1)[row].as_py() or "")
                size += len(texts[-1])
                if size >= _OUTPUT_CHARS or row + 1 == batch.num_rows:
                    ids = own.encode(texts)
                    columns = [batch.column(0).slice(first, len(ids)), pa.array([len(r) for r in ids], pa.int64()), _lists(ids)]
                    if back:
                        columns.append(pa.array([own.decode(r) for r in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    first, texts, size = row + 1, [], 0

    return in_arrow(docs.select("doc_id", "text"), run,
                    f"doc_id {kind}, n_tokens long, input_ids array<int>" + (", decoded binary" if back else ""))


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, input_ids of every row's whole text, without special tokens.

    ``ranks_path`` must be readable on every executor. Null and empty texts have no ids. Rows that
    repeat are encoded each; doc_id may be null; an empty table gives an empty result. Columns other
    than doc_id and text are not read.
    """
    return _encoded(docs, ranks_path, pattern, back=False)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str = PATTERN) -> DataFrame:
    """As ``encode``, with ``decoded``: the bytes that the ids stand for, in one pass over the texts."""
    return _encoded(docs, ranks_path, pattern, back=True)


def decode(encoded: DataFrame, ranks_path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, decoded: the bytes of every row's ``input_ids``.

    Null ids, and ids that the vocabulary hasn't, stand for no bytes; a null list gives null.
    """
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            rows = (x.values for x in batch.column(1))
            texts = [None if ids is None else own.decode(ids.fill_null(-1).to_numpy(zero_copy_only=False)) for ids in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return in_arrow(encoded.select("doc_id", "input_ids"), run, f"doc_id {kind}, decoded binary")
