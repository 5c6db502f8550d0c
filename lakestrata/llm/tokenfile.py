"""Token ids in files that give any token without decoding its neighbours.

Directly addressable codes: an id is cut into chunks of ``WIDTH`` bits, lowest first. Level k holds the
chunks number k of all ids that have so many, and a bitmap says of each whether its id goes on at the
next level. The place there is the number of set bits before it, for which a directory
counts the bits before each block. A table of segments in Parquet holds them: Spark's own commit
protocol makes the files whole even when tasks are repeated, and any store that Spark writes to will do.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakestrata.llm.shared import Memo, per_process

WIDTH = 8
BLOCK = 512  # bits between two counts of the directory
SEGMENT = 500_000  # a segment ends with the document that reaches so many ids

SCHEMA = """part int, seq int, n_tokens long, doc_ids array<long>, doc_ends array<long>,
            levels array<binary>, bitmaps array<binary>, ranks array<binary>"""


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and directories of an array of ids; an empty array has one empty level."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        more = rest >> WIDTH > 0
        levels.append((rest & ((1 << WIDTH) - 1)).astype(np.uint8).tobytes())
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        sums = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1)
        bitmaps.append(bits.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(sums)]).astype("<u4").tobytes())
        rest = rest[more] >> WIDTH
        if not len(rest):
            return levels, bitmaps, ranks


class Codes:
    """Reads ids by place from the levels of one segment."""

    def __init__(self, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self.bitmaps = [np.frombuffer(x, np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    def __len__(self) -> int:
        return len(self.levels[0])

    def rank(self, level: int, at: int) -> int:
        """Set bits of a level's bitmap before ``at``."""
        block = at // BLOCK
        begin = block * BLOCK // 8
        bits = self.bitmaps[level][begin : at // 8]
        rest = int(self.bitmaps[level][at // 8]) & ((1 << at % 8) - 1) if at % 8 else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(bits).sum()) + rest.bit_count()

    def token(self, at: int) -> int:
        """The id at one place: a chunk, a bit and a count on each level."""
        value, level = 0, 0
        while True:
            value |= int(self.levels[level][at]) << (WIDTH * level)
            if not self.bitmaps[level][at // 8] >> (at % 8) & 1:
                return value
            at, level = self.rank(level, at), level + 1

    def tokens(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """The ids of a range of places; only that range of each level is read."""
        out = self.levels[level][start:stop].astype(np.uint32)
        if start == stop:
            return out
        bits = np.unpackbits(self.bitmaps[level][start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :][: stop - start].astype(bool)
        if bits.any():
            begin = self.rank(level, start)
            out[bits] |= self.tokens(begin, begin + int(bits.sum()), level + 1) << WIDTH
        return out


_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)").fullmatch
_MARKS = re.compile(r"[!-/:-@\[-`{-~]*").fullmatch
#: How byte-level tokenizers write the bytes of such letters: those that are no printable sign of Latin-1 by signs from U+0100 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_SIGNS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_BYTES = {c: "".join(_SIGNS[b] for b in chr(c).encode()) for c in range(0xC0, 0x250)}


class WordEncoder:
    """Ids by a byte-level tokenizer of the tokenizers library, which encodes each distinct word once per worker.

    Words with the blank before them are encoded apart by such a tokenizer, so new words go through the
    library in one string, and an id that begins with a blank begins a word. Texts with other
    blanks, or that hold a special token, go through the library whole.
    """

    WORDS = 250_000  # held in each of two halves; the older one goes when the newer one is full
    TOGETHER = 100  # words in one string for the library, which takes longer for a word of a long string
    PART = 1 << 22  # characters of text whose words are told apart at a time

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A byte-level pattern makes one piece of letters and the blank before them, and one of the marks that follow to the next blank.
        before = self.library.pre_tokenizer
        self.plain = self.library.normalizer is None and type(before).__name__ == "ByteLevel" and before.use_regex and not before.add_prefix_space
        self.plain = self.plain and not any("\n" in t or t.isalpha() or _MARKS(t) or _PLAIN(t) for t in self.special)  # which such words might hold
        self.firsts, self.tails, self.bare = Memo(self.whole, 50_000), Memo(self.whole, 10_000), Memo(lambda letters: self.piece(letters, ""), 50_000)
        self.tokenize = self.library.model.tokenize

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, letters: str, before: str = "Ġ") -> bytes:
        """Ids of letters that are a piece for the model, together with the sign before them."""
        return array("I", [t.id for t in self.tokenize(before + (letters if letters.isascii() else letters.translate(_BYTES)))]).tobytes()

    def learn(self, words: list[str]) -> list[bytes | None]:
        """Ids of new words, each with a blank before it; None for an odd one, which has none.

        Where it is plain what pieces reach the library's model, they are encoded piece by piece; many others as one string.
        """
        known, out, rest = self.known, [None] * len(words), range(len(words))
        if self.plain:
            tails, bare, piece, rest = self.tails, self.bare, self.piece, []
            for k, w in enumerate(words):
                if w.isascii() and w.isalpha():
                    if (ids := known.get(w)) is None:
                        known[w] = ids = piece(w)
                    out[k] = ids
                    continue
                # A line may end within a word: its break is a piece, and the next line begins without a blank.
                end, line, start = w.partition("\n")
                if not (m := _PLAIN(end)) or line and not (after := _PLAIN(start)):
                    rest.append(k)
                    continue
                letters, tail = m.groups()
                if (ids := known.get(letters)) is None:
                    known[letters] = ids = piece(letters)
                if tail:
                    ids += tails[tail]
                if line:
                    letters, tail = after.groups()
                    ids += tails[line] + bare[letters]
                    if tail:
                        ids += tails[tail]
                known[w] = out[k] = ids
        odd = self.odd([words[k] for k in rest])
        rest = [k for k in rest if words[k] not in odd]
        for begin in range(0, len(rest), self.TOGETHER):
            some = rest[begin : begin + self.TOGETHER]
            text = " " + " ".join([words[k] for k in some])
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            starts = (np.flatnonzero(self.opens[ids]) * 4).tolist()
            if len(starts) != len(some):
                raise ValueError("the tokenizer does not keep words apart")
            data = ids.tobytes()
            for k, a, b in zip(some, starts, [*starts[1:], len(data)]):
                known[words[k]] = out[k] = data[a:b]
        return out

    def odd(self, words: list[str]) -> set[str]:
        """Words that are empty, have other white space at an end and so do not stand between two lone blanks, or hold a special token."""
        found = {w for w in words if not w or w[0].isspace() or w[-1].isspace()}
        if any(s in joined for joined in ["\n".join(words)] for s in self.special):
            found.update(w for w in words if any(s in w for s in self.special))
        return found

    def ids(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of different words with a blank before each, and which of the words are odd and have none."""
        if len(self.known) > self.WORDS:
            self.known, self.older = {}, self.known
        known, older, odd = self.known, self.older, np.zeros(len(words), bool)
        pieces = list(map(known.get, words))
        new = [k for k, p in enumerate(pieces) if p is None]
        if older:
            for k in new:
                if (p := older.get(words[k])) is not None:
                    known[words[k]] = pieces[k] = p
            new = [k for k in new if pieces[k] is None]
        for k, p in zip(new, self.learn([words[k] for k in new])):
            if p is None:
                odd[k], p = True, b""
            pieces[k] = p
        return pieces, odd

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string())
        out, begin, size = [], 0, 0
        for end, n in enumerate(pc.utf8_length(column).to_pylist(), 1):
            size += n
            if size > self.PART or end == len(column):
                out += self._encode(column[begin:end])
                begin, size = end, 0
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        """Every occurrence of a word is a number, so ids are put together by array operations."""
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        at, names = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        begins = np.cumsum(lengths := pc.list_value_length(split).to_numpy()) - lengths
        firsts = [names[k] for k in at[begins].tolist()]
        pieces, odd = self.ids(names)
        data = np.frombuffer(b"".join(pieces), "<u4")
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        starts = np.cumsum(sizes) - sizes
        # The first word has no blank before it and is encoded apart.
        n, other = sizes[at], odd[at] if odd.any() else np.zeros(len(at), bool)
        n[begins], other[begins] = 0, False
        total = int(n.sum())
        kind = np.int32 if max(total, len(data)) < 1 << 31 else np.int64
        place = np.repeat((starts[at] - (np.cumsum(n) - n)).astype(kind), n)
        place += np.arange(total, dtype=kind)
        flat = data[place].tobytes()
        ends = np.cumsum(np.add.reduceat(n, begins)) * 4
        out = []
        for k, first, bad, a, b in zip(range(len(texts)), firsts, np.logical_or.reduceat(other, begins).tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            if bad or first[-1:].isspace() or any(s in first for s in self.special):
                out.append(self.whole(texts[k].as_py()))
            else:
                out.append((self.firsts[first] if first else b"") + flat[a:b])
        return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text, add ``end_id`` to each, and write all ids in ascending order of doc_id.

    The texts are dealt to ranges of doc_id before they are encoded, so each task writes a stretch of
    the whole sequence, segment after segment. A null text is empty and has the end id only; rows that
    share a doc_id are ordered by text, and a null doc_id comes first. Other columns are ignored.
    """
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = per_process(("words", tokenizer), lambda: WordEncoder(tokenizer)), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, ends, pieces, total = [], [], [], 0

        def segment():
            levels, bitmaps, ranks = pack(np.frombuffer(b"".join(pieces), "<u4"))
            row = {"part": part, "seq": seq, "n_tokens": total, "doc_ids": doc_ids, "doc_ends": ends, "levels": levels, "bitmaps": bitmaps, "ranks": ranks}
            kinds = {"part": pa.int32(), "seq": pa.int32(), "n_tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()), "doc_ends": pa.list_(pa.int64())}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.list_(pa.binary()))) for k, v in row.items()], list(row))

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"])):
                pieces += (ids, end)
                total += len(ids) // 4 + 1
                doc_ids.append(doc_id)
                ends.append(total)
                if total >= SEGMENT:
                    yield segment()
                    doc_ids, ends, pieces, total, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield segment()

    dealt.mapInArrow(encode, SCHEMA).write.parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, start): how many ids stand before each segment.

    Sums are taken within a part, then over the parts, of which there are as many as tasks wrote.
    """
    sizes = spark.read.schema(SCHEMA).parquet(path).select("part", "seq", "n_tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    parts = parts.select("part", F.coalesce(F.sum("size").over(before.orderBy("part")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("seq")), F.lit(0))
    return sizes.withColumn("inside", inside).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Of each written document its doc_id, start, number of ids, and the crc32 of its ids as unsigned 32-bit integers."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["levels"], row["bitmaps"], row["ranks"])
                begins = [0, *row["doc_ends"][:-1]]
                ids = codes.tokens(0, len(codes)).astype("<u4")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins, row["doc_ends"])]
                n = len(crcs)
                columns = [
                    pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(begins, pa.int64()), pa.array(np.diff([0, *row["doc_ends"]]), pa.int64()), pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])

    kind = "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long"
    read = spark.read.schema(SCHEMA).parquet(path).mapInArrow(decode, kind)
    placed = read.join(starts(spark, path), ["part", "seq"])
    return placed.select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
