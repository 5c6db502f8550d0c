"""Byte-level BPE through a minimal acyclic transducer of frequent words; all other words are merged exactly.

Words are counted over all texts. The most frequent ones are merged once and compiled into an acyclic automaton
that reads the bytes of a word and writes its ids: every id stands on the first arc where all words that pass agree on it, and
states that accept the same endings with the same ids are one. The automaton is a file of flat arrays that Spark hands
to every executor and that its workers map into memory. Workers look up all distinct words of a stretch of texts side
by side, one byte of each at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.llm.shared import per_batch, per_process
from lakestrata.session import scratch_path

WORDS = 65_536  # frequent words in the automaton; the bound of its size
LONGEST = 64  # bytes of a frequent word
STRETCH = 4 << 20  # characters of text that are looked up together
PARTIAL = 300_000  # distinct words that a task counts before it hands them on
LONG = 48  # bytes of a piece beyond which it is merged by a heap, on its own
NEVER = 1 << 62

#: A blank between two characters that are no white space: no piece goes over its left side.
_BORDER = re.compile(r"(?<=\S)(?= \S)")
#: The pattern that byte-level tokenizers split texts by, with white space as Unicode lists it; a fixed value.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+").findall
#: From here on libraries differ in which characters they know as letters, so the tokenizer's own library splits such texts.
_RECENT = re.compile("[\u0530-\U0010ffff]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` from ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class Ragged:
    """Rows of different sizes in one array."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, sizes
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, rows: list[bytes] | list[list[int]], kind) -> Ragged:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.frombuffer(b"".join(rows), kind) if rows and isinstance(rows[0], bytes) else np.fromiter(chain.from_iterable(rows), kind, int(sizes.sum()))
        return cls(flat, sizes)

    def take(self, at: np.ndarray) -> np.ndarray:
        """The rows at some places, one after the other."""
        return gather(self.values, self.starts[at], self.sizes[at])

    def fill(self, at: np.ndarray, rows: Ragged) -> Ragged:
        """The same with other rows at some places."""
        starts, sizes = self.starts.copy(), self.sizes.copy()
        starts[at], sizes[at] = rows.starts + len(self.values), rows.sizes
        return Ragged(gather(np.concatenate([self.values, rows.values]), starts, sizes), sizes)


class Merger:
    """A byte-level BPE tokenizer file: how it splits texts, its merges, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        added = library.get_added_tokens_decoder()
        plain = model["normalizer"] is None and model["pre_tokenizer"]["type"] == "ByteLevel" and not model["pre_tokenizer"]["add_prefix_space"]
        if not plain or any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("only byte-level tokenizers without normalizer, prefix blank and special white space are read")
        letters = byte_letters()
        self.to_bytes = str.maketrans({c: chr(b) for b, c in letters.items()})
        vocab = model["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.pair_keys = np.array([(a << 32) + b for a, b in self.merges], np.int64)
        self.pair_ranks = np.array([rank for rank, _ in self.merges.values()], np.int64)
        self.made = np.array([new for _, new in sorted(self.merges.values())], np.int64)
        order = np.argsort(self.pair_keys)
        self.pair_keys, self.pair_ranks = self.pair_keys[order], self.pair_ranks[order]
        self.single = [vocab[letters[b]] for b in range(256)]
        self.singles = np.array(self.single, np.int64)
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.special = {t.content: i for i, t in added.items()}
        names = {i: self.letters(t) for t, i in vocab.items()} | {i: t.content.encode() for i, t in added.items()}
        self.texts = [names.get(i, b"") for i in range(max(names) + 1)]
        by_length = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None

    def letters(self, text: str) -> bytes:
        """The bytes that a text of byte letters stands for."""
        return text.translate(self.to_bytes).encode("latin-1")

    def merge(self, word: bytes) -> list[int]:
        """Ids of one piece of text: the pair of the least rank merges first, the left one of equals."""
        return self.merge_all([word]).values.tolist()

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def merge_all(self, words: list[bytes]) -> Ragged:
        """Ids of each of many pieces. All pieces take a merge at a time; only the pairs beside a merge are ranked again."""
        rows = Ragged.of(words, np.uint8)
        out_row, out_ids = [], []
        for i in np.flatnonzero(rows.sizes > LONG).tolist():
            found = self._merge_long([self.single[b] for b in words[i]])
            out_row.append(np.full(len(found), i))
            out_ids.append(np.array(found, np.int64))
        row = np.repeat(np.arange(len(words)), rows.sizes)
        ids = self.singles[rows.values]
        short = rows.sizes[row] <= LONG
        row, ids = row[short], ids[short]
        rank = np.full(len(ids), NEVER, np.int64)
        beside = np.flatnonzero(row[:-1] == row[1:])
        rank[beside] = self._ranks(ids[beside], ids[beside + 1])
        while len(ids):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            sizes = np.diff(np.append(first, len(row)))
            low = np.repeat(np.minimum.reduceat(rank, first), sizes)
            over = low == NEVER
            if over.any():
                out_row.append(row[over])
                out_ids.append(ids[over])
                row, ids, rank, low = row[~over], ids[~over], rank[~over], low[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == low)
            at = at[np.diff(row[at], prepend=-1) != 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # where the merged ids stand once the second halves are gone
            row, ids, rank = row[keep], ids[keep], rank[keep]
            rank[at] = NEVER
            ahead = at[at + 1 < len(row)]
            ahead = ahead[row[ahead] == row[ahead + 1]]
            rank[ahead] = self._ranks(ids[ahead], ids[ahead + 1])
            back = at[at > 0] - 1
            back = back[row[back] == row[back + 1]]
            rank[back] = self._ranks(ids[back], ids[back + 1])
        row, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_row, out_ids))
        return Ragged(ids[np.argsort(row, kind="stable")].astype(np.int32), np.bincount(row, minlength=len(words)))

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has merged with another
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < n and (pair := merges.get((ids[k], ids[m]))):
                    heapq.heappush(heap, (pair[0], k, pair[1], ids[k], ids[m]))
        return [i for i in ids if i >= 0]

    def pieces(self, text: str) -> list[str]:
        """The pieces that merges stay within."""
        if _RECENT.search(text):
            return [text[a:b] for _, (a, b) in self.split(text)]
        return _PIECES(text)


def shared_start(a: tuple, b: tuple) -> int:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


class State:
    __slots__ = "arcs", "ends", "rest"

    def __init__(self):
        self.arcs: list[list] = []  # [byte, ids, state], the last one still open
        self.ends, self.rest = False, ()  # whether a word ends here, and the ids it still writes then


def compile_words(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> list[tuple[list, bool, tuple]]:
    """The minimal transducer of (word, ids) in ascending order of distinct words, as (arcs, ends, rest) of each state.

    Words share the path of their common beginning; ids that they do not share move on along the arcs. When a word
    leaves the path of the one before it, what that one has alone is complete: a state equal to a known one
    becomes that one. Arcs are (byte, ids, number of a state); the last state is the start.
    """
    known: dict[tuple, int] = {}
    done: list[tuple] = []

    def settle(state: State) -> int:
        key = (tuple(map(tuple, state.arcs)), state.ends, state.rest)
        if key not in known:
            known[key] = len(done)
            done.append(key)
        return known[key]

    path, last = [State()], b""
    for word, ids in words:
        same = shared_start(word, last)
        for k in range(len(last), same, -1):
            path[k - 1].arcs[-1][2] = settle(path.pop())
        left = tuple(ids)
        for k in range(same):
            arc, state = path[k].arcs[-1], path[k + 1]
            n = shared_start(arc[1], left)
            if moved := arc[1][n:]:
                for other in state.arcs:
                    other[1] = moved + other[1]
                if state.ends:
                    state.rest = moved + state.rest
                arc[1] = arc[1][:n]
            left = left[n:]
        for b in word[same:]:
            path[-1].arcs.append([b, left, None])
            path.append(State())
            left = ()
        path[-1].ends, path[-1].rest = True, left
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1].arcs[-1][2] = settle(path.pop())
    settle(path[0])
    return done


#: Layout of the file: a header of eight counts, then these arrays.
PARTS = {"keys": "<i8", "targets": "<i4", "begins": "<i4", "counts": "<i4", "ends": "<i1", "rest_begins": "<i4", "rest_counts": "<i4", "ids": "<i4"}


class Lexicon:
    """A compiled transducer as flat arrays over one buffer, which may be a mapped file.

    ``keys`` holds state * 256 + byte of every arc in ascending order, so an arc is found by a binary search.
    """

    def __init__(self, buffer: np.ndarray):
        counts = buffer[:64].view("<i8").tolist()
        at = 64
        for (name, kind), n in zip(PARTS.items(), counts):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, buffer[at : at + size].view(kind))
            at += -(-size // 8) * 8
        self.start = len(self.ends) - 1

    @staticmethod
    def image(states: list[tuple[list, bool, tuple]]) -> bytes:
        ids: list[int] = []
        at: dict[tuple, int] = {}

        def place(out: tuple) -> tuple[int, int]:
            if out not in at:
                at[out] = len(ids)
                ids.extend(out)
            return at[out], len(out)

        arcs = [(s * 256 + byte, target, *place(out)) for s, (found, _, _) in enumerate(states) for byte, out, target in sorted(found)]
        rest = [place(r) for _, _, r in states]
        columns = [*([c for c in zip(*arcs)] or [()] * 4), [e for _, e, _ in states], *zip(*rest), ids]
        arrays = [np.array(c, kind) for c, kind in zip(columns, PARTS.values())]
        parts = [np.array([len(a) for a in arrays], "<i8").tobytes()]
        for a in arrays:
            parts += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
        return b"".join(parts)

    @classmethod
    def build(cls, words: Iterable[tuple[bytes, tuple[int, ...]]]) -> Lexicon:
        return cls(np.frombuffer(cls.image(compile_words(sorted(words))), np.uint8))

    @classmethod
    def map(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.uint8, "r"))

    def look_up(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, Ragged]:
        """Which of the words ``data[starts : starts + sizes]`` are here, and the ids of each (none if it is not).

        All words take a step at a time, so the work is that of their bytes, in a few array operations a step.
        """
        n = len(starts)
        state, word = np.full(n, self.start, np.int64), np.arange(n)
        if not len(self.keys):
            word = word[:0]
        found, order, begins, counts = np.zeros(n, bool), [], [], []
        step = 0
        while len(word):
            over = sizes[word] == step
            ended = word[over]
            here = state[ended]
            good = self.ends[here] > 0
            found[ended] = good
            order.append(ended)
            begins.append(np.where(good, self.rest_begins[here], 0))
            counts.append(np.where(good, self.rest_counts[here], 0))
            word = word[~over]
            key = state[word] * 256 + data[starts[word] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            word, arc = word[hit], arc[hit]
            state[word] = self.targets[arc]
            order.append(word)
            begins.append(self.begins[arc])
            counts.append(self.counts[arc])
            step += 1
        order = np.concatenate(order) if order else word
        counts = np.concatenate(counts).astype(np.int64) if counts else word
        begins = np.concatenate(begins).astype(np.int64) if begins else word
        counts = np.where(found[order], counts, 0)
        order, begins, counts = order[counts > 0], begins[counts > 0], counts[counts > 0]
        by_word = np.argsort(order, kind="stable")
        values = gather(self.ids, begins[by_word], counts[by_word])
        return found, Ragged(values, np.bincount(order, counts, n).astype(np.int64))


class Speller:
    """Texts to ids by a lexicon, and by merging what it lacks."""

    def __init__(self, merger: Merger, lexicon: Lexicon):
        self.merger, self.lexicon = merger, lexicon
        self.names = Ragged.of(merger.texts, np.uint8)
        self.decimals = Ragged.of([b"%d," % i for i in range(len(merger.texts))], np.uint8)

    def _pieces(self, pieces: list[bytes]) -> Ragged:
        """Ids of distinct pieces."""
        rows = Ragged.of(pieces, np.uint8)
        found, ids = self.lexicon.look_up(rows.values, rows.starts, rows.sizes)
        lacking = np.flatnonzero(~found)
        return ids.fill(lacking, self.merger.merge_all([pieces[i] for i in lacking.tolist()]))

    def _rows(self, pieces: list[str], begins: np.ndarray) -> Ragged:
        """Ids of rows of pieces, of which each row begins at a place of its own."""
        place = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        known = self._pieces([p.encode() for p in place])
        at = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        return Ragged(known.take(at), np.add.reduceat(known.sizes[at], begins) if len(begins) else known.sizes[:0])

    def _others(self, chunks: list[str]) -> Ragged:
        """Ids of distinct parts of texts that the lexicon does not hold whole, from their pieces."""
        split = [self.merger.pieces(c) for c in chunks]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        return self._rows(list(chain.from_iterable(split)), np.cumsum(sizes) - sizes)

    def words(self, words: list[str]) -> Ragged:
        """Ids of distinct words without white space at their ends, each with a blank before it."""
        data = np.frombuffer("".join(" " + w for w in words).encode(), np.uint8)
        starts = np.flatnonzero(data == 32)
        found, ids = self.lexicon.look_up(data, starts, np.diff(np.append(starts, len(data))))
        lacking = np.flatnonzero(~found)
        # Pieces of all lacking words from one string, or two: a blank begins a word and nothing else.
        recent = np.array([bool(_RECENT.search(words[i])) for i in lacking.tolist()], bool)
        lacking = np.concatenate([lacking[~recent], lacking[recent]])
        several = [" " + words[i] for i in lacking.tolist()]
        known = len(lacking) - int(recent.sum())
        pieces = self.merger.pieces("".join(several[:known])) + self.merger.pieces("".join(several[known:]))
        begins = np.flatnonzero([p[0] == " " for p in pieces])
        if len(begins) != len(lacking):
            raise ValueError("the tokenizer does not keep words apart")
        return ids.fill(lacking, self._rows(pieces, begins))

    def chunks(self, text: str) -> list[str | int]:
        """A text as parts that no piece crosses, special tokens as their ids."""
        segments = self.merger.specials.split(text) if self.merger.specials else [text]
        return [c for s in segments if s for c in ([self.merger.special[s]] if s in self.merger.special else _BORDER.split(s))]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > STRETCH:
                yield from self._encode(some)
                some, size = [], 0
        yield from self._encode(some)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        # Words after a blank go by their names; first words, and all that stands beside other blanks, are parts of their own.
        split = [t.split(" ") for t in texts]
        words = set(chain.from_iterable(s[1:] for s in split))
        odd = {w for w in words if not w or w[0].isspace() or w[-1].isspace()}
        words = list(words - odd)
        place = dict(zip(words, range(len(words))))
        parts: dict[str | int, int] = {}
        rows = []
        for text, (first, *rest) in zip(texts, split):
            if first[-1:].isspace() or any(s in text for s in self.merger.special) or (odd and not odd.isdisjoint(rest)):
                row = []
                for c in self.chunks(text):
                    at = place.get(c[1:]) if isinstance(c, str) and c[0] == " " else None
                    row.append(-1 - parts.setdefault(c, len(parts)) if at is None else at)
            else:
                row = list(map(place.__getitem__, rest))
                if first:
                    row.insert(0, -1 - parts.setdefault(first, len(parts)))
            rows.append(row)
        known = self.words(words)
        others = [c for c in parts if isinstance(c, str)]
        at = np.flatnonzero([isinstance(c, str) for c in parts])
        more = Ragged.of([[] if isinstance(c, str) else [c] for c in parts], np.int32).fill(at, self._others(others))
        # Parts are counted down from -1, so they stand behind the words in turned order.
        both = Ragged(np.concatenate([known.values, more.values]), np.concatenate([known.sizes, more.sizes]))
        for row in rows:
            at = np.array(row, np.int64)
            yield both.take(np.where(at < 0, len(words) - 1 - at, at))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become the replacement character."""
        return self.names.take(ids).tobytes().decode(errors="replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by commas."""
        return self.decimals.take(ids)[:-1].tobytes()


def frequent_words(docs: DataFrame, most: int = WORDS) -> list[str]:
    """The most frequent words of all texts that follow a blank, ties to the smaller one; at most ``most`` of up to ``LONGEST`` bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            record = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return record

        for batch in batches:
            for text in batch["text"].to_pylist():
                seen.update((text or "").split(" ")[1:])
                if len(seen) > PARTIAL:
                    yield out()
        yield out()

    words = docs.select("text").mapInArrow(count, "word string, n long").where(F.octet_length("word").between(1, LONGEST - 1))
    top = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r["word"] for r in top.select("word").collect()]


def compile_lexicon(words: list[str], merger: Merger) -> bytes:
    """The file of a lexicon of words that follow a blank; words that white space or a special token takes part in are left out."""
    good = sorted({w for w in words if w and not w[0].isspace() and not w[-1].isspace() and not any(s in w for s in merger.special)})
    ids = Speller(merger, Lexicon.build([])).words(good)
    rows = np.split(ids.values, ids.starts[1:])
    return Lexicon.image(compile_words(sorted(((" " + w).encode(), tuple(r.tolist())) for w, r in zip(good, rows))))


def publish(spark: SparkSession, image: bytes) -> str:
    """Write the file to the shared folder and let Spark hand it to every executor, later ones included; the name to ask for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'lexicon')}.bin")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(image))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return path.getName()


def worker_speller(tokenizer: str, name: str) -> Speller:
    merger = per_process(("merger", tokenizer), lambda: Merger(tokenizer))
    return Speller(merger, Lexicon.map(SparkFiles.get(name)))


def prepare(docs: DataFrame, tokenizer: str, most: int = WORDS) -> str:
    """Count, compile and publish; the name of the lexicon."""
    return publish(docs.sparkSession, compile_lexicon(frequent_words(docs, most), Merger(tokenizer)))


def encode(docs: DataFrame, tokenizer: str, most: int = WORDS) -> DataFrame:
    """doc_id and ids of every whole text, as the tokenizers library gives them without adding special tokens.

    A special token's string in a text is that token. A null or empty text has no ids; repeated rows are encoded
    each, null doc_ids stay null, other columns are ignored and no rows give none. ``tokenizer`` is read on the executors.
    """
    name = prepare(docs, tokenizer, most)

    def make():
        speller = worker_speller(tokenizer, name)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(speller.encode([t or "" for t in batch["text"].to_pylist()]))
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return step

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids count as none."""

    def make():
        merger = per_process(("merger", tokenizer), lambda: Merger(tokenizer))
        speller = Speller(merger, Lexicon.build([]))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [speller.decode(np.array(ids or [], np.int64)) for ids in batch["ids"].to_pylist()]
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

        return step

    return per_batch(encoded.select(F.col("doc_id").cast("long"), "ids"), make, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, most: int = WORDS) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids joined by commas and of the text that they decode to; rows as in ``encode``."""
    name = prepare(docs, tokenizer, most)

    def make():
        speller = worker_speller(tokenizer, name)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, ids_hash, text_hash = [], [], []
            for ids in speller.encode([t or "" for t in batch["text"].to_pylist()]):
                sizes.append(len(ids))
                ids_hash.append(hashlib.sha256(speller.decimal(ids)).hexdigest())
                text_hash.append(hashlib.sha256(speller.decode(ids).encode()).hexdigest())
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
