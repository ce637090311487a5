"""Byte-level BPE: encoding by a priority queue over a linked list, decoding by concatenation.

A pre-token's bytes form a doubly linked list of symbols; a heap holds the ranks of adjacent pairs.
The lowest rank merges first; entries whose symbols have changed since are stale and are skipped.
That is O(n log n) in the length of the pre-token, however long it is. Results per chunk of text are
remembered for the life of a worker, within a bounded table, as natural text repeats its words.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pre-token pattern of the public 50k byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks remembered per worker, in two generations of this many. It bounds memory, not results.
MEMORY = 500_000


class Encoder(dict):
    """Maps a chunk of text to its token ids, packed as 32-bit integers; computed when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, i in ranks.items():
            self.vocabulary[i] = piece
        self.whole = {piece: i for piece, i in ranks.items() if len(piece) > 1}
        self.byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        #: (left id, right id) -> rank of their merge, which is also the id of the merged symbol.
        self.pairs = {
            ranks[piece[:c]] << 32 | ranks[piece[c:]]: i for piece, i in ranks.items() for c in range(1, len(piece)) if piece[:c] in ranks and piece[c:] in ranks
        }
        self.split = regex.compile(PATTERN).findall
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if (ids := self.old.get(chunk)) is None:
            if (chunk[1:] or "x").isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
                ids = self.merge(chunk.encode())
            elif chunk[-1] in ",.!?;:" and chunk[1:-1].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
                return self[chunk[:-1]] + self[chunk[-1]]
            elif len(words := self.split(chunk)) == 1:
                ids = self.merge(chunk.encode())
            else:
                return b"".join(map(self.__getitem__, words))
        if len(chunk) < 100:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def merge(self, raw: bytes) -> bytes:
        """The token ids of one pre-token."""
        if (whole := self.whole.get(raw)) is not None:
            return whole.to_bytes(4, "little")
        pairs, n = self.pairs.get, len(raw)
        symbol = [self.byte[b] for b in raw]  # -1 once merged away
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := pairs(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if (left := symbol[i]) < 0 or (j := after[i]) >= n or pairs(left << 32 | symbol[j]) != rank:
                continue  # stale: one of its symbols has changed
            symbol[i], symbol[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pairs(rank << 32 | symbol[k])) is not None:
                    push(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := pairs(symbol[h] << 32 | rank)) is not None:
                push(heap, r << 32 | h)
        return array("i", [x for x in symbol if x >= 0]).tobytes()

    def encode(self, text: str) -> bytes:
        """All token ids, packed. A text may be cut before a single space between two other characters,
        as that space always opens the next pre-token; what lies between cuts is looked up as one."""
        return b"".join(map(self.__getitem__, chunks(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_RARE = "\t\r\0\x0b\x0c\x1c\x1d\x1e\x1f"
_RARE_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = regex.compile(r"(?<=\S)(?= \S)")


def chunks(text: str) -> list[str]:
    """The text cut where pre-tokens surely end: before a lone space and around a lone line feed."""
    if not text:
        return []
    if (
        "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[0] == " " or text[-1] == " "
        or any(map(text.__contains__, _RARE)) or not text.isascii() and _RARE_WIDE.search(text)
    ):
        return _CUT.split(text)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


@lru_cache(4)
def load(path: str) -> Encoder:
    """The encoder of a rank file (a base64 piece and its rank per line), once per worker."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a})


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(id columns, token_ids, n_tokens, decoded_ok)`` for every row; decoding gives back the text.

    ``vocabulary`` is a rank file that every executor can read at that path. One narrow pass without
    a shuffle; each text is encoded as a whole and decoded again, and ``decoded_ok`` says whether the
    bytes agree. A null text gives null tokens, count and verdict; an empty one an empty list, 0 and
    true. Very long texts and words without spaces take O(n log n). Repeated rows each give a row; an
    empty table gives an empty one. Of the input only the named columns are read, so others can't clash.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in id_columns) + ", token_ids array<int>, n_tokens int, decoded_ok boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed, counts, ok = [], [], []
                for t in part.column(len(id_columns)).to_pylist():
                    x = None if t is None else enc.encode(t)
                    packed.append(x or b"")
                    counts.append(None if t is None else len(x) // 4)
                    ok.append(None if t is None else enc.decode(memoryview(x).cast("i")) == t.encode())
                flat = pa.array(np.frombuffer(b"".join(packed), np.int32), pa.int32())
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]), pa.int32())
                column = pa.ListArray.from_arrays(offsets, flat, mask=pa.array([c is None for c in counts], pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], column, pa.array(counts, pa.int32()), pa.array(ok, pa.bool_())], names=[*id_columns, "token_ids", "n_tokens", "decoded_ok"]
                )

    return docs.select(*id_columns, text).mapInArrow(run, schema)

