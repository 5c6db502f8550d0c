"""Near-duplicate documents: MinHash bands find candidates, odd sketches weigh them, full sets confirm them.

An odd sketch folds the MinHash samples of a document into a bitmap of parities, one flip a sample. Samples that
two documents share cancel out in the XOR of their sketches, so its bits count the samples that differ,
and the count is most exact where few differ.

Equal sets become one class with one representative. Bands of representatives that meet in a bucket
are not paired with each other. First every member is held against the best of the smallest
ids in its buckets, and what is confirmed is joined into components. Only buckets that still hold
several components are paired, across components and in blocks, so a large group of near copies never
becomes a list of its pairs, and no link between two components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.shared import components, mix, per_batch, raw, word_hashes
from lakestrata.session import materialize

SHINGLE = 5
SIMILAR = 75  # per cent
BANDS, ROWS = 32, 4  # two sets of similarity 0.75 miss each other in all bands once in 200,000 pairs
SAMPLES = BANDS * ROWS
BINS = 2048  # one more sample for each bin of hash values, for the sketch only
BITS = 2048
TRIES = 4  # further members that the rest of a bucket is held against before it is paired
BLOCK = 2_000  # members of a bucket that one task holds against the whole bucket, which it reads as a stream
HOT = 2_000  # members that one task confirms against their leader


SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = mix(SEEDS) | np.uint64(1)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of all runs of five words; of fewer words, of the whole run; of none, none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, SHINGLE)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k])
    return np.unique(out)


def min_samples(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, in pieces that stay in the processor's cache."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(low, ((found[None, at : at + 1024] ^ SEEDS[:, None]) * FACTORS[:, None]).min(1), out=low)
    return low


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """Parities of how many samples fall on each bit, as 64-bit words; the samples are the least hash in each bin.

    Two sets have the same sample in a bin, of those that either has one in, as often as they are similar.
    """
    low = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    mixed = mix(found ^ np.uint64(0x5851F42D4C957F2D))
    np.minimum.at(low, (found % np.uint64(BINS)).astype(np.int64), mixed)
    at = mix(low[low != np.iinfo(np.uint64).max]) % np.uint64(BITS)
    parity = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.uint64)


def most_bits(a, b, m=F):
    """Differing bits that the sketches of two similar sets of these sizes exceed about once in three million pairs.

    A bin flips a bit for each set that has a sample in it, and none if it is the same one. Samples are drawn without
    replacement, so small sets leave little to chance; five standard errors of that and of flips that meet.
    Takes columns, or arrays with numpy for ``m``.
    """
    j = SIMILAR / 100
    union = (a + b) / (1 + j)
    filled = lambda n: BINS * (1 - m.exp(-n / BINS))
    bins = filled(union)
    flips = filled(a) + filled(b) - 2 * j * bins
    drawn = 4 * j * (1 - j) * bins * (1 - bins / union) * m.exp(-4 * flips / BITS)
    return BITS / 2 * (1 - m.exp(-2 * flips / BITS)) + 5 * m.sqrt(drawn + flips * flips / (BITS / 2) + 1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, its odd sketch and its band keys, from whole texts."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, digests, sketches, bands = [], [], [], []
            for text in raw(batch, "text"):
                found = shingles(word_hashes((text or b"").lower()))
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                samples = min_samples(found)
                sketches.append(odd_sketch(found).view(np.int64))
                bands.append(band_keys(samples).view(np.int64))
            lists = lambda rows: pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(rows)), len(rows[0])).cast(pa.list_(pa.int64()))
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists(sketches), lists(bands)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "sketch", "bands"])

        return step

    return per_batch(docs.select("doc_id", "text"), make, "doc_id long, n_shingles long, digest binary, sketch array<long>, bands array<long>")


def close_sketches(a: str, b: str) -> Column:
    """Differing bits of two sketches."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))


def may_match(a: str, b: str) -> Column:
    """Sizes that allow the similarity, and sketches that are near enough."""
    sizes = F.least(f"{a}.n_shingles", f"{b}.n_shingles") * 100 >= F.greatest(f"{a}.n_shingles", f"{b}.n_shingles") * SIMILAR
    most = most_bits(F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles"))
    return sizes & (close_sketches(f"{a}.sketch", f"{b}.sketch") <= most)


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (u, v: distinct, u <> v) whose full sets are similar.

    Each v's texts go to its u in groups of bounded size, the text of u to all of them; texts that no
    pair names are not moved further than the join that finds the others. A group is read as a stream.
    """
    pairs = materialize(pairs, "pairs")
    parts = F.ceil(F.col("n") / HOT).cast("int")
    sizes = pairs.groupBy("u").agg(F.count("*").alias("n")).withColumn("parts", parts)
    members = pairs.join(sizes, "u").select(F.col("v").alias("doc_id"), "u", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("place"))
    leaders = sizes.select(F.col("u").alias("doc_id"), "u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"))
    wanted = materialize(members.unionByName(leaders), "wanted")
    texts = docs.select("doc_id", "text").join(wanted, "doc_id")
    dealt = texts.repartition("u", "part").sortWithinPartitions("u", "part", "place", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leads = None, []
        for batch in batches:
            us, vs = [], []
            rows = zip(batch["u"].to_pylist(), batch["part"].to_pylist(), batch["place"].to_pylist(), batch["doc_id"].to_pylist(), raw(batch, "text"))
            for u, part, place, doc_id, text in rows:
                if (u, part) != group:
                    group, leads = (u, part), []
                found = shingles(word_hashes((text or b"").lower()))
                if not place:
                    leads.append(found)  # more than one only if rows share a doc_id
                    continue
                for lead in leads:
                    both = len(np.intersect1d(lead, found, assume_unique=True))
                    if both and 100 * both >= SIMILAR * (len(lead) + len(found) - both):
                        us.append(u)
                        vs.append(doc_id)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def pairs_across(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of one bucket (key) and two components whose sketches allow the similarity, each in one bucket only.

    A bucket is dealt to tasks in blocks of bounded size; a task holds its block and reads the bucket as a
    stream. Two rows of different components leave every bucket that they share mixed, so all of those are
    in ``rows``, and the pair is named by the first of them.
    """
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    columns = "key", "doc_id", "component", "n_shingles", "sketch", "bands"
    held = rows.select(*columns, F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"), F.lit(0).alias("place"))
    read = rows.select(*columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("place"))
    dealt = held.unionByName(read).repartition("key", "part").sortWithinPartitions("key", "part", "place")

    def numbers(column: pa.Array) -> np.ndarray:
        return column.to_numpy(zero_copy_only=False)

    def table(column: pa.ListArray) -> np.ndarray:
        return numbers(column.flatten()).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block, kept = None, [], None
        for batch in batches:
            key, part, place, ids, component, sizes = (numbers(batch[c]) for c in ("key", "part", "place", "doc_id", "component", "n_shingles"))
            sketches, bands = table(batch["sketch"]).view(np.uint64), table(batch["bands"])
            us, vs = [], []
            for i in range(len(ids)):
                if (key[i], part[i]) != group:
                    group, block, kept = (key[i], part[i]), [], None
                if not place[i]:
                    block.append((ids[i], component[i], sizes[i], sketches[i], bands[i]))
                    continue
                if not block:
                    continue
                if kept is None:
                    kept = [np.array(c) for c in zip(*block)]
                low, high = np.minimum(kept[2], sizes[i]), np.maximum(kept[2], sizes[i])
                at = np.flatnonzero((kept[0] < ids[i]) & (kept[1] != component[i]) & (low * 100 >= high * SIMILAR))
                bits = np.bitwise_count(kept[3][at] ^ sketches[i]).sum(1, dtype=np.int64)
                at = at[bits <= most_bits(kept[2][at], sizes[i], np)]
                shared = kept[4][at] == bands[i]
                at = at[bands[i][shared.argmax(1)] == key[i]]
                us.append(kept[0][at])
                vs.append(np.full(len(at), ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (us, vs)], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    A null or wordless text has an empty set and is linked with nothing. Repeated rows have one set and
    come out alike; rows that share a doc_id with other texts are linked by each text on its own. A row with a null doc_id cannot be named, so
    it is kept, with a null component. Other columns are ignored; no rows give none. Sets are compared as
    64-bit hashes of their shingles.
    """
    rows = materialize(signatures(docs), "signatures")
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n_shingles", "sketch", "bands"), "doc_id").alias("s"))
    classes = materialize(classes.select("digest", "doc_id", "s.*"), "classes")
    sketches = classes.select("doc_id", "n_shingles", "sketch")
    members = classes.select("doc_id", F.explode("bands").alias("key")).distinct()
    buckets = materialize(members.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1"), "buckets")
    crowded = materialize(members.join(buckets, "key"), "crowded")

    def best_of(stars: DataFrame) -> DataFrame:
        """For each doc_id the leader with the nearest sketch, as a pair."""
        # A document's sketch joins its list of leaders, of which there are few, and not every one of them.
        listed = stars.groupBy("doc_id").agg(F.collect_set("leader").alias("leaders")).join(sketches, "doc_id")
        tried = listed.select("doc_id", "n_shingles", "sketch", F.explode("leaders").alias("leader")).alias("a").join(sketches.withColumnRenamed("doc_id", "leader").alias("b"), "leader").where(may_match("a", "b"))
        best = tried.groupBy("doc_id").agg(F.min(F.struct(close_sketches("a.sketch", "b.sketch").alias("bits"), "leader")).alias("best"))
        return best.select(F.least("doc_id", "best.leader").alias("u"), F.greatest("doc_id", "best.leader").alias("v")).distinct()

    def still_open(links: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with these."""
        found = components(links).withColumnRenamed("node", "doc_id")
        placed = crowded.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        return materialize(placed.join(mixed, "key"), "open")

    stars = crowded.where("doc_id <> leader").select("doc_id", "leader")
    links = materialize(confirm(best_of(stars), docs), "links")
    # The smallest member need not be the one that a group has most in common with: some others, by hash.
    rest = still_open(links)
    some = rest.groupBy("key").agg(F.array_distinct(F.array(*(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(i))) for i in range(TRIES)))).alias("some"))
    stars = rest.join(some, "key").select("doc_id", "component", F.explode("some").alias("leader")).distinct()
    of_leader = rest.select(F.col("doc_id").alias("leader"), F.col("component").alias("other")).distinct()
    stars = stars.join(of_leader, "leader").where("component <> other").select("doc_id", "leader")
    links = materialize(links.unionByName(confirm(best_of(stars), docs)).distinct(), "links")

    weighed = classes.select("doc_id", "n_shingles", "sketch", "bands")
    open_rows = still_open(links).select("key", "doc_id", "component", "n").join(weighed, "doc_id")
    more = confirm(pairs_across(open_rows), docs)

    linked = components(links.unionByName(more)).withColumnRenamed("node", "doc_id")
    named = materialize(classes.select("digest", "doc_id").join(linked, "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("component")), "named")
    out = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
