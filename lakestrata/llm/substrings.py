"""Passages that stand in an earlier document: suffix automata of reference shards, and documents streamed past them.

An automaton of reference passages is read word by word; after each word its state tells the longest end
of what was read that occurs in the references. Wherever that is ``WINDOW`` words or more, the words it covers are removed.

What can serve as reference grows with the corpus, so automata of everything can't be broadcast. Each shard holds the
passages of one reference document that recur in later documents, and the passages of later documents
that belong to it are dealt to the same task, in groups of bounded size. To find who belongs to whom:
the least hash of the 25-word runs in a window is the same wherever the window stands, and few of them are
needed for a document. Only windows whose least hash occurs in several documents are hashed
whole, and the smallest doc_id with such a window is its reference. Documents of equal words are settled first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakestrata.llm.shared import mix, per_batch, raw, word_hashes
from lakestrata.session import materialize

WINDOW = 50
RUN = 25
GROUP_WORDS = 200_000  # words of later documents that one task streams past a copy of one automaton


class Automaton:
    """A suffix automaton of word sequences: every run of words that occurs in one of them is a path from state 0."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, word) -> int:
        """The state of exactly one word more than ``at``; longer ways to the same target keep theirs."""
        target = self.next[at][word]
        if self.length[target] == self.length[at] + 1:
            return target
        twin = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = twin
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def add(self, words: list) -> None:
        """Add one sequence."""
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            new, at = self._state(self.length[last] + 1, {}, 0), last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, word)
            last = new

    def spans(self, words: list, least: int) -> list[tuple[int, int]]:
        """Maximal stretches of ``words`` covered by matches of ``least`` words or more, by matching statistics."""
        out: list[tuple[int, int]] = []
        state = size = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            if size >= least:
                start = i + 1 - size
                if out and start <= out[-1][1]:
                    out[-1] = (min(out[-1][0], start), i + 1)
                else:
                    out.append((start, i + 1))
        return out


def joined(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of runs from hashes of their two halves, the second ``gap`` words later."""
    n = len(b) - gap
    return mix(a[:n] * np.uint64(0x9E3779B97F4A7C15) + b[gap:])


def window_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of 50 words the least hash of its 25-word runs, and a hash of the whole."""
    two = joined(hashes, hashes, 1)
    four = joined(two, two, 2)
    eight = joined(four, four, 4)
    sixteen = joined(eight, eight, 8)
    runs = joined(joined(sixteen, eight, 16), hashes, 24)
    low = np.minimum(runs[:-1], runs[1:])
    for step in (2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[:-10], low[10:])  # 16 and 16 of them are 26
    whole = joined(joined(sixteen, sixteen, 16), joined(sixteen, two, 16), 32)
    return low, whole


def base(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, words_sha256 (of all words joined by a blank) and the least hashes of the windows of every row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, lows = [], [], []
            for text in raw(batch, "text"):
                words = (text or b"").split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                lows.append(np.unique(window_hashes(word_hashes(text))[0]).view(np.int64) if len(words) >= WINDOW else [])
            columns = [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(digests), pa.array(lows, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "words_sha256", "lows"])

        return step

    return per_batch(docs.select("doc_id", "text"), make, "doc_id long, n_words long, words_sha256 string, lows array<long>")


def _islands(rows: DataFrame) -> DataFrame:
    """Runs of windows of one document with one reference, as (doc_id, words_sha256, owner, start, stop) in words."""
    order = Window.partitionBy("doc_id", "words_sha256", "owner").orderBy("pos")
    runs = rows.withColumn("run", F.col("pos") - F.row_number().over(order))
    return runs.groupBy("doc_id", "words_sha256", "owner", "run").agg(F.min("pos").alias("start"), (F.max("pos") + WINDOW).alias("stop")).drop("run")


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three frames, by doc_id and words_sha256, which together name a row.

    * every row: doc_id, n_words, words_sha256;
    * rows that are repeated whole: the words of an earlier document of 50 words or more;
    * other rows with repeated passages: text and spans, an array of (start, stop) in words, maximal and in order.

    A null or wordless text has no words. A row with a null doc_id is neither changed nor a reference. Rows that share a
    doc_id are parts of one document and no reference for each other. No rows give none; other columns are ignored.
    """
    rows = materialize(base(docs), "words")
    long = rows.where(f"doc_id is not null and n_words >= {WINDOW}")
    first = materialize(long.groupBy("words_sha256").agg(F.min("doc_id").alias("first")), "first")
    copies = long.select("doc_id", "words_sha256").join(first, "words_sha256").where("doc_id > first").select("doc_id", "words_sha256").distinct()
    originals = long.join(first, (long["words_sha256"] == first["words_sha256"]) & (long["doc_id"] == first["first"])).select("doc_id", long["words_sha256"], F.explode("lows").alias("low"))
    shared = originals.groupBy("low").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("low")
    wanted = originals.join(materialize(shared, "shared"), "low").groupBy("doc_id", "words_sha256").agg(F.collect_set("low").alias("lows"))
    wanted = materialize(wanted, "wanted")

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [hashlib.sha256(b" ".join((t or b"").split())).hexdigest() for t in raw(batch, "text")]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(found)], ["doc_id", "text", "words_sha256"])

    named = per_batch(docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id"), lambda: digest, "doc_id long, text string, words_sha256 string")
    texts = materialize(named.dropDuplicates(["doc_id", "words_sha256"]), "texts")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            places, wholes = [], []
            for text, lows in zip(raw(batch, "text"), batch["lows"]):
                low, whole = window_hashes(word_hashes(text))
                at = np.flatnonzero(np.isin(low, lows.values.to_numpy(zero_copy_only=False).view(np.uint64)))
                places.append(at.astype(np.int32))
                wholes.append(whole[at].view(np.int64))
            columns = [batch["doc_id"], batch["words_sha256"], pa.array(places, pa.list_(pa.int32())), pa.array(wholes, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "words_sha256", "places", "wholes"])

        return step

    keys = ["doc_id", "words_sha256"]
    hashed = per_batch(texts.join(wanted, keys), make, "doc_id long, words_sha256 string, places array<int>, wholes array<long>")
    hashed = materialize(hashed, "windows")
    windows = hashed.select(*keys, F.explode(F.arrays_zip("places", "wholes")).alias("w")).select(*keys, F.col("w.places").alias("pos"), F.col("w.wholes").alias("whole"))
    owners = windows.groupBy("whole").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("whole", "owner")
    islands = materialize(_islands(windows.join(owners, "whole")), "islands")

    later = islands.where("owner < doc_id")
    sizes = later.groupBy("owner").agg(F.ceil(F.sum(F.col("stop") - F.col("start")) / GROUP_WORDS).cast("int").alias("parts"))
    sizes = materialize(sizes, "sizes")
    placed = islands.join(sizes, "owner")
    own = F.col("owner") == F.col("doc_id")
    part = F.when(own, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "start"), F.col("parts")).cast("int")))
    jobs = placed.groupBy(*keys).agg(F.collect_list(F.struct("owner", "start", "stop", part.alias("parts"))).alias("jobs"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, sha, text, jobs in zip(batch["doc_id"].to_pylist(), batch["words_sha256"].to_pylist(), raw(batch, "text"), batch["jobs"].to_pylist()):
            words = text.split()
            for j in jobs:
                passage = b" ".join(words[j["start"] : j["stop"]])
                out += [(j["owner"], part, doc_id, sha, j["start"], passage) for part in j["parts"]]
        kinds = {"owner": pa.int64(), "part": pa.int32(), "doc_id": pa.int64(), "words_sha256": pa.string(), "start": pa.int32(), "passage": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds.values())], list(kinds))

    passages = per_batch(texts.join(jobs, keys), lambda: cut, "owner long, part int, doc_id long, words_sha256 string, start int, passage binary")
    own = (F.col("doc_id") != F.col("owner")).cast("int").alias("place")
    dealt = passages.withColumn("place", own).repartition("owner", "part").sortWithinPartitions("owner", "part", "place", "doc_id", "start")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, automaton = None, Automaton()
        for batch in batches:
            found = []
            columns = [batch[c].to_pylist() for c in ("owner", "part", "place", "doc_id", "words_sha256", "start", "passage")]
            for owner, part, place, doc_id, sha, start, passage in zip(*columns):
                if (owner, part) != group:
                    group, automaton = (owner, part), Automaton()
                words = passage.split(b" ")
                if not place:
                    automaton.add(words)
                else:
                    found += [(doc_id, sha, start + a, start + b) for a, b in automaton.spans(words, WINDOW)]
            kinds = {"doc_id": pa.int64(), "words_sha256": pa.string(), "start": pa.int32(), "stop": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 4, kinds.values())], list(kinds))

    spans = dealt.mapInArrow(match, "doc_id long, words_sha256 string, start int, stop int")
    spans = materialize(spans.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans")), "spans")
    return rows.select("doc_id", "n_words", "words_sha256"), copies, texts.join(spans, keys)


def without(words: list[bytes], spans: list[dict]) -> list[bytes]:
    """The words outside of the spans, which are in order and may overlap."""
    out, at = [], 0
    for s in spans:
        if s["start"] > at:
            out += words[at : s["start"]]
        at = max(at, s["stop"])
    return out + words[at:]


def cleaned(passages: DataFrame) -> DataFrame:
    """doc_id, words_sha256, n_kept and the kept words joined by a blank, of rows with repeated passages."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [without(t.split(), s) for t, s in zip(raw(batch, "text"), batch["spans"].to_pylist())]
        columns = [batch["doc_id"], batch["words_sha256"], pa.array([len(k) for k in kept], pa.int64()), pa.array([b" ".join(k).decode() for k in kept], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "words_sha256", "n_kept", "kept"])

    return per_batch(passages, lambda: step, "doc_id long, words_sha256 string, n_kept long, kept string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    rows, copies, passages = repeated(docs)
    changed = cleaned(passages).select("doc_id", "words_sha256", "n_kept", F.sha2("kept", 256).alias("sha"))
    changed = changed.unionByName(copies.select("doc_id", "words_sha256", F.lit(0).cast("long").alias("n_kept"), F.sha2(F.lit(""), 256).alias("sha")))
    out = rows.join(changed, ["doc_id", "words_sha256"], "left")
    removed = F.coalesce(F.col("n_words") - F.col("n_kept"), F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.coalesce("sha", "words_sha256").alias("kept_sha256"))


def remove(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; where words are removed, the text is the kept words joined by a blank.

    A column ``n_chars`` then counts the characters of the new text. A document that is repeated whole keeps its row with an empty text.
    """
    _, copies, passages = repeated(docs)
    changed = cleaned(passages).select("doc_id", "words_sha256", "kept")
    changed = changed.unionByName(copies.select("doc_id", "words_sha256", F.lit("").alias("kept")))
    # One row per doc_id, and in it the new text by the digest that names a row.
    changed = changed.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("words_sha256", "kept"))).alias("texts"))
    words = F.array_join(F.filter(F.split("d.text", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), " ")
    both = docs.alias("d").join(changed.alias("c"), F.col("d.doc_id") == F.col("c.doc_id"), "left")
    kept = F.when(F.col("c.texts").isNotNull(), F.try_element_at("c.texts", F.sha2(words, 256)))
    texts = {"text": F.coalesce(kept, F.col("d.text"))}
    if "n_chars" in docs.columns:
        texts["n_chars"] = F.coalesce(F.length(kept), F.col("d.n_chars")).cast(docs.schema["n_chars"].dataType)
    return both.select(*(texts.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))
