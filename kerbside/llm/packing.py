"""Packing token sequences: best-fit decreasing over windows of a fixed number of tokens.

A document's ids are cut into full windows; what is left over is packed with other documents' rests
into the tightest open window that holds it, found with a segment tree over remaining capacities.
Packing happens where the documents are read: a task packs its own documents in bounded groups, so
no token is shuffled and a task that is run again gives the same rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kerbside.llm.common import in_arrow

WINDOW = 2048
END_ID = 1
GROUP_TOKENS = 1 << 23  # tokens of one packing group
SLACK = 8  # a window this close to full is closed before the task ends
_OUTPUT_TOKENS = 1 << 20  # about as many tokens a batch of output


#: Fixed value: how byte-level tokenizers of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Ids of whole texts, by the vocabulary of a byte-level tokenizer file.

    The file's ids follow the order of its merges, so they serve as ranks of the faster encoder with
    the same result. Texts that hold one of the file's added tokens go to the file's own tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        byte_of = _byte_of()
        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()
                 if all(c in byte_of for c in token) and not re.fullmatch(r"<\|.*\|>", token)}
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(token in text for token in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()


class OpenWindows:
    """Open windows by remaining capacity: a segment tree that finds the tightest one that is enough."""

    def __init__(self, window: int):
        self.leaves = 1
        while self.leaves <= window:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def _change(self, left: int, by: int) -> None:
        node = self.leaves + left
        while node:
            self.count[node] += by
            node //= 2

    def put(self, left: int, window: int) -> None:
        self.at[left].append(window)
        self._change(left, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(remaining capacity, window) of the fullest window with room for need, or None."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node % 2 or not self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        left = node - self.leaves
        window = self.at[left].pop()
        self._change(left, -1)
        return left, window


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Windows as lists of positions in ``lengths``, each length at most the window."""
    tree, windows = OpenWindows(window), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            windows.append([i])
            left = window - lengths[i]
            at = len(windows) - 1
        else:
            left, at = found[0] - lengths[i], found[1]
            windows[at].append(i)
        if left:
            tree.put(left, at)
    return windows


class Piece(NamedTuple):
    """A run of a document's ids."""

    doc_id: object
    doc_tokens: int
    start: int
    ids: bytes

    @property
    def size(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple["Piece", "Piece"]:
        return (self._replace(ids=self.ids[:4 * at]), self._replace(start=self.start + at, ids=self.ids[4 * at:]))


def fill_up(pieces: list[Piece], window: int) -> list[list[Piece]]:
    """The last pieces of a task, cut freely into full windows and, at the end, windows whose
    lengths are the powers of two of the remainder, which need no padding."""
    total = sum(p.size for p in pieces)
    sizes = [window] * (total // window)
    sizes += [1 << b for b in range(window.bit_length(), -1, -1) if total % window >> b & 1]
    out, queue = [], list(reversed(pieces))
    for size in sizes:
        held = []
        while size:
            piece = queue.pop()
            if piece.size > size:
                piece, rest = piece.cut(size)
                queue.append(rest)
            held.append(piece)
            size -= piece.size
        out.append(held)
    return out


def close_fullest(windows: list[list[Piece]], window: int, most: int) -> tuple[list[list[Piece]], list[Piece]]:
    """(full windows, pieces kept): where open windows hold more than ``most`` ids, pieces of the fullest
    are cut to fill them; less than ``most`` and a window stays."""
    windows = sorted(windows, key=lambda w: sum(p.size for p in w))
    upto = np.cumsum([sum(p.size for p in w) for w in windows])
    stay = int(np.searchsorted(upto, most, "right"))
    kept = [p for w in windows[:stay] for p in w]
    filled = fill_up([p for w in windows[stay:] for p in w], window)
    done = [w for w in filled if sum(p.size for p in w) == window]
    return done, kept + [p for w in filled[len(done):] for p in w]


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with
    ``keep_ids``, the ids.

    ``tokenizer_path`` must be readable on every executor. A document's ids end with id 1; null text
    is empty and gives that id alone. Every id lies in exactly one piece. Sequence numbers are unique,
    their upper part is the task's partition. Documents that repeat are packed each; doc_id may be
    null. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long" + (", input_ids array<int>" if keep_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        held: list[Piece] = []  # of windows still open
        number, tokens, id_type = 0, 0, None

        def rows(windows):
            nonlocal number
            out = [[] for _ in range(8)]
            for pieces in windows:
                offset = 0
                for p in pieces:
                    for column, value in zip(out, (p.doc_id, p.start, p.size, zlib.crc32(p.ids), p.doc_tokens,
                                                   base + number, offset)):
                        column.append(value)
                    if keep_ids:
                        out[7].append(np.frombuffer(p.ids, "<u4").astype(np.int32))
                    offset += p.size
                number += 1
            arrays = [pa.array(out[0], id_type)] + [pa.array(c, pa.int64()) for c in out[1:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                arrays.append(pa.array(out[7], pa.list_(pa.int32())))
                names.append("input_ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        def packed(last: bool):
            nonlocal held, tokens
            windows = [[held[i] for i in w] for w in best_fit_decreasing([p.size for p in held], window)]
            done = [w for w in windows if sum(p.size for p in w) >= window - SLACK]
            still = [w for w in windows if sum(p.size for p in w) < window - SLACK]
            held = [p for w in still for p in w]
            if not last:
                more, held = close_fullest(still, window, GROUP_TOKENS // 2)
                done += more
            if last:
                done, held = done + fill_up(held, window), []
            tokens = sum(p.size for p in held)
            return done

        for batch in batches:
            doc_ids, id_type = batch.column(0).to_pylist(), batch.column(0).type
            texts, full, size = batch.column(1), [], 0
            for at, doc_id in enumerate(doc_ids):
                ids = encoder.encode(texts[at].as_py() or "") + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                full += [[Piece(doc_id, n, s, ids[4 * s:4 * (s + window)])] for s in range(0, n - window + 1, window)]
                if n % window:
                    held.append(Piece(doc_id, n, n - n % window, ids[4 * (n - n % window):]))
                size, tokens = size + n, tokens + n % window
                if size >= _OUTPUT_TOKENS or at + 1 == len(doc_ids):
                    if full:
                        yield rows(full)
                    full, size = [], 0
                if tokens >= GROUP_TOKENS:
                    yield rows(packed(last=False))
        if held:
            yield rows(packed(last=True))

    return in_arrow(docs.select("doc_id", "text"), run, schema)
