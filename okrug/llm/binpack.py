"""Containers of fixed capacity filled by bounded-space online best fit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN_BINS, ITEMS_A_SHARD = 64, 20_000
ROW = "limit_id int, shard int, container int, place int, piece_no int, first_token bigint, tokens bigint"


class Packer:
    """Places items one by one: at most `most_open` containers are open; a bitset has bit f set while an open container has f free.

    An item goes to the open container with the least free space that holds it. A full container closes at once; if too
    many are open, the fullest closes first.
    """

    def __init__(self, capacity: int, most_open: int = OPEN_BINS):
        self.capacity, self.most_open = capacity, most_open
        self.free, self.open, self.count, self.used = 0, {}, 0, 0

    def _take(self, space: int) -> list[int]:
        bins = self.open[space]
        one = bins.pop()
        if not bins:
            del self.open[space]
            self.free &= ~(1 << space)
        self.used -= 1
        return one

    def place(self, size: int) -> tuple[int, int]:
        """(container, place in it), both from 1."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number, filled = self._take(space)
        else:
            self.count += 1
            number, filled, space = self.count, 0, self.capacity
        left = space - size
        if left:
            self.open.setdefault(left, []).append((number, filled + 1))
            self.free |= 1 << left
            self.used += 1
            if self.used > self.most_open:
                self._take((self.free & -self.free).bit_length() - 1)
        return number, filled + 1


def pack_documents(sizes: DataFrame, limits: list[tuple[int, int]], doc_id: str = "doc_id", tokens: str = "tokens", most_open: int = OPEN_BINS, items_a_shard: int = ITEMS_A_SHARD) -> DataFrame:
    """(doc_id, limit_id, shard, container, place, piece_no, first_token, tokens) for each of `limits`, (limit_id, capacity).

    (limit_id, shard, container) names a container; the tokens of its rows never exceed the capacity. An item that fits a
    container is never divided; a longer one fills containers of its own with its first pieces, and only its rest is packed. Items are
    packed in the order of a hash of their ids, shard by shard; each shard holds about `items_a_shard` items, so that at
    most `most_open` containers in each are left less than full.

    An item of no tokens, or null, takes a place without space. Repeated ids are items of their own; an empty table
    gives none. Only ids and sizes are shuffled; shards are even whatever the data, as rows are dealt by hash.
    """
    for _, capacity in limits:
        if capacity < 1:
            raise ValueError("a container has a capacity of one at least")
    items = sizes.select(F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)), F.lit(0)).alias("tokens"))
    schema = f"doc_id {dict(items.dtypes)['doc_id']}, {ROW}"
    if not limits:
        return sizes.sparkSession.createDataFrame([], schema)
    shards = max(1, -(-items.count() // items_a_shard))
    # the hash takes the size too, so that a null or repeated id doesn't draw all its rows to one shard
    dealt = items.withColumn("h", F.xxhash64("doc_id", "tokens")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, packers = None, []
        for batch in batches:
            rows = []
            for doc, size, at in zip(batch["doc_id"], batch["tokens"], batch["shard"]):
                if at != shard:
                    shard, packers = at, [(limit, Packer(capacity, most_open)) for limit, capacity in limits]
                for limit, packer in packers:
                    first, no, rest = 1, 1, size
                    while rest > packer.capacity:
                        rows.append((doc, limit, shard, *packer.place(packer.capacity), no, first, packer.capacity))
                        first, no, rest = first + packer.capacity, no + 1, rest - packer.capacity
                    rows.append((doc, limit, shard, *packer.place(rest), no, first, rest))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "doc_id", "tokens").select("doc_id", "tokens", "shard").mapInPandas(fill, schema)
