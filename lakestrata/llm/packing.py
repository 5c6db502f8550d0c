"""Best-fit packing into sequences of several permitted lengths.

Pieces are taken longest first. A piece goes into the open bin that it leaves fullest; if none has
room, a bin opens whose size costs least for what it will hold, as far as the pieces still to come tell:
each permitted length is filled on trial by best fit from the counts of the lengths left. At the end every
bin shrinks to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.session import materialize

LENGTHS = (512, 1024, 2048, 4096)
PIECES = 20_000  # pieces that are packed together, about


def cost(length: int) -> float:
    """Of a sequence in a step: its tokens, attention over them, and a share for being a row at all."""
    return length + length * length / 16_384 + 16


class Packer:
    """Best fit over one list of piece lengths."""

    def __init__(self, lengths: tuple[int, ...] = LENGTHS, price: Callable[[int], float] = cost):
        self.lengths, self.price = sorted(lengths), price

    def _open(self, need: int, left: dict[int, int], sizes: list[int]) -> int:
        """The permitted length with the least price for each token that it would hold."""
        best = None
        for length in self.lengths[bisect_left(self.lengths, need) :]:
            room, taken = length - need, {}
            at = bisect_right(sizes, room)
            while at:
                size = sizes[at - 1]
                many = min(room // size, left[size])
                if many:
                    taken[size] = many
                    room -= many * size
                at = min(at - 1, bisect_right(sizes, room))
            filled = length - room
            # What it would shrink to in the end is what it costs.
            final = self.lengths[bisect_left(self.lengths, filled)]
            offer = (self.price(final) / filled, -length)
            if best is None or offer < best[0]:
                best = offer, length
        return best[1]

    def pack(self, pieces: list[int]) -> tuple[list[int], list[int]]:
        """The bin of each piece and the final length of each bin; every piece must fit the longest length."""
        order = sorted(range(len(pieces)), key=lambda i: (-pieces[i], i))
        left: dict[int, int] = {}
        for n in pieces:
            left[n] = left.get(n, 0) + 1
        sizes = sorted(left)
        rooms: list[tuple[int, int]] = []  # (room, bin) of open bins, least room first
        where, used, opened = [0] * len(pieces), [], []
        for i in order:
            n = pieces[i]
            left[n] -= 1
            if not left[n]:
                del left[n]
                del sizes[bisect_left(sizes, n)]
            at = bisect_left(rooms, (n, -1))
            if at < len(rooms):
                room, k = rooms.pop(at)
            else:
                k, room = len(used), self._open(n, left, sizes)
                used.append(0)
                opened.append(room)
            where[i] = k
            used[k] += n
            if room > n:
                insort(rooms, (room - n, k))
        return where, [self.lengths[bisect_left(self.lengths, n)] for n in used]


def word_count(text: Column) -> Column:
    """Words between ASCII white space, as the sequence length of a text; a null or blank text has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))


def pack(docs: DataFrame, size: Column, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Pack whole documents, cut at the longest permitted length where they are longer.

    One row per piece: doc_id, piece (from 0), start (tokens of the document before it), size, pack_group and bin
    (together the sequence), place (tokens of the sequence before the piece) and capacity (its final length).
    A null or negative size counts as 0; a document of size 0 has one piece of size 0, which is in the
    first bin of its group at no cost. Repeated rows are packed each; other columns are ignored; no rows give none.

    Pieces are dealt evenly by a hash of their place into groups of about ``PIECES``, each packed by
    one task. A group leaves a few bins partly filled, hundredths of a per cent of its bins.
    """
    longest = max(lengths)
    sized = docs.select("doc_id", F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("total"))
    sized = materialize(sized, "sizes")
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("total") / longest) - 1, F.lit(0).cast("long")))
    pieces = sized.select("doc_id", "total", F.explode(cuts).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("total") - F.col("piece") * longest).alias("size"))
    groups = max(1, -(-pieces.count() // PIECES))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    dealt = dealt.repartition(groups, "pack_group").sortWithinPartitions("pack_group", "doc_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(lengths)

        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows).combine_chunks()
            sizes = whole["size"].to_pylist()
            real = [i for i, n in enumerate(sizes) if n]
            where, finals = packer.pack([sizes[i] for i in real])
            bins, places, used = [0] * len(sizes), [0] * len(sizes), [0] * max(1, len(finals))
            for i, k in zip(real, where):
                bins[i], places[i] = k, used[k]
                used[k] += sizes[i]
            finals = finals or [min(lengths)]
            columns = {"bin": pa.array(bins, pa.int64()), "place": pa.array(places, pa.int64()), "capacity": pa.array([finals[k] for k in bins], pa.int64())}
            for name, column in columns.items():
                whole = whole.append_column(name, column)
            return whole.to_batches()[0]

        rows, group = [], None
        for batch in batches:
            start = 0
            keys = batch["pack_group"].to_numpy()
            for stop in [*(i + 1 for i in range(len(keys) - 1) if keys[i] != keys[i + 1]), len(keys)]:
                if rows and keys[start] != group:
                    yield flush(rows)
                    rows = []
                group = keys[start]
                rows.append(batch.slice(start, stop - start))
                start = stop
        if rows:
            yield flush(rows)

    kind = "doc_id long, piece long, start long, size long, pack_group int, bin long, place long, capacity long"
    return dealt.mapInArrow(run, kind)
