"""Byte-level BPE by dynamic programming over prefixes.

Byte-pair encoding has a useful property: the encoding of any byte string is a chain in which
neighbouring tokens do not merge across their border, and there is one such chain only. So each prefix
of a string has one valid last token, the token that ends the prefix and goes with the last token of
what stands before it. A table of last tokens is all that is needed: a string is extended by
looking at its new end only, and an edit changes the table from its place until both tables agree again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lakestrata.llm.shared import Memo, per_batch, per_process, raw

NEVER = 1 << 62


class Ranks:
    """A vocabulary in rank order: the rank of a token is its id, and the lower rank merges first."""

    def __init__(self, ids: dict[bytes, int]):
        self.ids = ids
        self.text = {i: t for t, i in ids.items()}
        # Lengths of tokens by their last three bytes, longest first.
        ends: dict[bytes, set[int]] = {}
        for t in ids:
            ends.setdefault(t[-3:], set()).add(len(t))
        shorter = lambda e: {n for n in range(1, len(e)) if e[-n:] in ids}
        self.ends = {e: sorted(n | shorter(e), reverse=True) for e, n in ends.items()}
        self.left = Memo(lambda t: self._edge(t, 0), 1_000_000)
        self.right = Memo(lambda t: self._edge(t, 1), 1_000_000)
        self.fits = Memo(self._fits, 2_000_000)

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(n) for t, n in map(bytes.split, lines)})

    def merge(self, data: bytes, below: int = NEVER) -> list[int]:
        """Plain merging, with ranks lower than ``below`` only; the definition that the table must agree with."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at one edge of a token while it forms: each piece, and the rank that ends its life."""
        pieces = [(self.text[token], NEVER)]
        while len(self.text[token]) > 1:
            parts = self.merge(self.text[token], token)
            if len(parts) != 2:
                return []  # merging never makes this token
            pieces.append((self.text[parts[-side]], token))
            token = parts[-side]
        return pieces[::-1]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens side by side stay as they are.

        Their edges form independently, lower ranks first. The pieces that meet at the border at a
        time merge if that comes before the next merge of either; of equal ranks the left one comes first.
        """
        a, b = self.right[pair[0]], self.left[pair[1]]
        if not a or not b:
            return False
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across = self.ids.get(x + y, NEVER)
            if across < x_ends and across <= y_ends and across != NEVER:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def lengths(self, data: bytes, end: int) -> list[int]:
        """Lengths that a token which ends ``data[:end]`` may have, longest first."""
        tail = data[max(0, end - 3) : end]
        while tail not in self.ends:
            tail = tail[1:]
        return self.ends[tail]

    def last(self, data: bytes, end: int, before) -> int:
        """The valid last token of ``data[:end]``; ``before(n)`` tells the one of ``data[:n]``."""
        ids, fits = self.ids, self.fits
        for n in self.lengths(data, end):
            if n > end:
                continue
            token = ids.get(data[end - n : end])
            if token is not None and (fits[before(end - n), token] if n < end else bool(self.right[token])):
                return token
        raise ValueError("a byte is missing from the vocabulary")


class PrefixTable:
    """The last token of every prefix of one byte string, kept up to date under appends and edits."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.lasts = ranks, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; nothing that stands before is looked at again, but for the tokens that may reach back."""
        start, self.data = len(self.data), self.data + more
        for end in range(start + 1, len(self.data) + 1):
            self.lasts.append(self.ranks.last(self.data, end, lambda n: self.lasts[n - 1]))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` for the bytes from start to stop; the number of prefixes that had to be computed.

        Behind the edit the old table holds again once the last tokens of a stretch as long as the
        longest token agree: what follows looks no further back.
        """
        tail = self.lasts[stop:]
        reach = max(map(len, self.ranks.ids))
        self.data, self.lasts = self.data[:start] + new + self.data[stop:], self.lasts[:start]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            token = self.ranks.last(self.data, end, lambda n: self.lasts[n - 1])
            self.lasts.append(token)
            k = end - start - len(new) - 1
            same = same + 1 if k >= 0 and tail[k] == token and len(self.ranks.text[token]) <= k + 1 else 0
            if same >= reach:
                self.lasts += tail[k + 1 :]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        """The encoding of the whole string, read from its end."""
        out, end = [], len(self.data)
        while end:
            out.append(self.lasts[end - 1])
            end -= len(self.ranks.text[out[-1]])
        return out[::-1]


#: A blank between two characters that are no white space: no match of the pattern goes over its left side.
_BORDER = re.compile(r"(?<=\S)(?= \S)")


class OtherBlanks(Exception):
    """A text has a blank beside other white space or at its end."""


class Encoder:
    """Texts to ids: each match of the pattern separately, through one table of prefixes that all short matches share.

    The table maps a prefix to its last token and to the entry of what stands before that token.
    """

    SHORT, PREFIXES, WORDS = 48, 400_000, 800_000

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks = ranks
        # White space as Unicode lists it, which is what the rank files were made with.
        self.matches = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.table: dict[bytes, tuple] = {}
        self.words = Memo(self._word, self.WORDS)

    def match_ids(self, data: bytes) -> list[int]:
        ranks, table, known = self.ranks, self.table, len(data)
        if data in ranks.ids:
            return [ranks.ids[data]]
        if known > self.SHORT:
            return PrefixTable(ranks, data).ids()
        if len(table) > self.PREFIXES:
            table.clear()
        entry = table.get(data)
        if entry is None:
            known -= 1
            while known and data[:known] not in table:
                known -= 1
            ids, fits, ends = ranks.ids, ranks.fits, ranks.ends
            for end in range(known + 1, len(data) + 1):
                for n in ends.get(data[max(0, end - 3) : end]) or ranks.lengths(data, end):
                    if n > end:
                        continue
                    token = ids.get(data[end - n : end])
                    if token is None:
                        continue
                    if n == end:
                        if ranks.right[token]:
                            entry = token, None
                            break
                    else:
                        before = table[data[: end - n]]
                        if fits[before[0], token]:
                            entry = token, before
                            break
                table[data[:end]] = entry
        out = []
        while entry:
            out.append(entry[0])
            entry = entry[1]
        return out[::-1]

    def piece(self, text: str) -> bytes:
        ids = array("I")
        for m in self.matches(text):
            ids.extend(self.match_ids(m.encode()))
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise OtherBlanks
        return self.piece(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        first, *words = text.split(" ")
        try:
            if first[-1:].isspace():
                raise OtherBlanks
            return self.piece(first) + b"".join(map(self.words.__getitem__, words))
        except OtherBlanks:
            return b"".join(map(self.piece, _BORDER.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def worker_encoder(path: str, pattern: str) -> Encoder:
    return per_process(("bpe", path, pattern), lambda: Encoder(Ranks.load(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every whole text. ``path`` is read on the executors.

    A null text is empty and has no ids; repeated rows are encoded each; other columns are ignored.
    """

    def make():
        encoder = worker_encoder(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [encoder.encode(t or "") for t in batch["text"].to_pylist()]
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

        return step

    return per_batch(docs.select("doc_id", "text"), make, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids of every text and of the bytes that the ids decode to, without keeping either."""

    def make():
        encoder = worker_encoder(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for text in raw(batch, "text"):
                ids = encoder.encode((text or b"").decode())
                found.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()))
            n, ids_hash, text_hash = zip(*found)
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names)

        return step

    return per_batch(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
