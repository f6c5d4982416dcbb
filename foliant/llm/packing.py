"""Filling containers of fixed capacity with texts: vector bin packing by the dot-product heuristic.

An item has three sizes: tokens, segments (1) and loss-bearing tokens, those after
its first line (of a text with one line, all). A container has a limit on each. An
item is cut only if it exceeds the capacity itself; the pieces before its last one
are as large as fits and fill a container each. A piece that alone has more
loss-bearing tokens than the limit is not cut for that; it stands in a container
alone, the only ones beyond that limit.

The pieces are spread over blocks by a hash, so that a block holds a bounded number
of them whatever the data. A block fills one container after the other: of the
pieces that still fit, it takes the one whose sizes have the greatest dot product
with the room left, each dimension weighted by its share in the block's demand.
Containers that a block leaves below ``full`` are dissolved, and their pieces go
through another round in fewer blocks.

Defined results: an item without tokens (a null or empty text) goes into no
container and has a null ``container``; repeated rows are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.tokenizer import BYTE_BPE, TOKENIZER_DIR, machine
from foliant.session import checkpoint

CAPACITY = 2_048
SEGMENTS = 32
BLOCK = 4_096


def pack_block(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_limit: int) -> np.ndarray:
    """Container number of each piece; every piece must fit an empty container."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    size = np.stack([tokens / capacity, np.full(n, 1 / segments), loss / max(1, loss_limit)], 1)
    weight = size.sum(0) / size.sum()
    # pieces of equal sizes are taken in their order; largest first, so that the pieces that fit are a suffix by tokens
    order = np.lexsort((-loss, -tokens))
    tok, los = tokens[order], loss[order]
    weighted = size[order] * weight
    free = np.ones(n, bool)
    out = np.empty(n, np.int64)
    left, container = n, 0
    while left:
        room, count, loss_room = capacity, segments, loss_limit
        while count:
            begin = int(np.searchsorted(-tok, -room, side="left"))
            if begin == len(tok):
                break
            fits = free[begin:] & (los[begin:] <= loss_room)
            gain = weighted[begin:] @ np.array([room / capacity, count / segments, loss_room / max(1, loss_limit)])
            gain[~fits] = -1.0
            best = int(gain.argmax())
            if gain[best] < 0:
                break
            best += begin
            out[order[best]] = container
            free[best] = False
            left -= 1
            room, count, loss_room = room - int(tok[best]), count - 1, loss_room - int(los[best])
        container += 1
        if left and left < 0.7 * len(tok):
            tok, los, weighted, order, free = tok[free], los[free], weighted[free], order[free], np.ones(left, bool)
    return out


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(id, row, tokens, head)``: tokens of the text, and of its first line if more lines follow. ``row`` tells repeated rows apart."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(vocabulary, folder)
        words, split = m.words, m.split
        for batch in batches:
            tokens, head = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(2).to_pylist()):
                if text:
                    first, mark, rest = text.partition("\n")
                    if mark and rest.strip():
                        lengths = np.fromiter(map(len, map(words.__getitem__, split(text))), np.int64)
                        head[i] = sum(len(words[w]) for w in split(first))
                        tokens[i] = lengths.sum()
                    else:
                        tokens[i] = sum(map(len, map(words.__getitem__, split(text))))
            head = np.minimum(head, tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens), pa.array(head)], names=[id_col, "row", "tokens", "head"])

    return df.select(id_col, F.monotonically_increasing_id().alias("row"), text_col).mapInArrow(run, f"`{id_col}` {kind}, row bigint, tokens bigint, head bigint")


def pieces(sizes: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """One row for each piece: ``piece``, ``first_token``, ``tokens`` and ``loss``."""
    cut = F.col("tokens") > capacity
    count = F.when(cut, F.ceil(F.col("tokens") / capacity)).otherwise(1).cast("int")
    step = F.when(cut, F.lit(capacity)).otherwise(F.col("tokens"))
    out = sizes.where("tokens > 0").withColumn("_step", step).withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    first = F.col("piece") * F.col("_step")
    last = F.least(first + F.col("_step"), "tokens")
    return out.select(id_col, "row", F.col("piece").cast("bigint").alias("piece"), first.alias("first_token"), (last - first).alias("tokens"), (last - F.greatest(first, F.least(F.col("head"), last))).alias("loss"))


def _round(parts: DataFrame, blocks: int, number: int, capacity: int, segments: int, loss_limit: int, id_col: str) -> DataFrame:
    """Pieces with ``block``, ``slot`` (container in the block), ``position`` in it and ``fill`` (of that container)."""
    keyed = parts.withColumn("block", F.pmod(F.xxhash64("row", "piece", F.lit(number)), F.lit(blocks)))
    schema = f"{', '.join(f'`{c}` {t}' for c, t in keyed.dtypes)}, slot bigint, position bigint, fill bigint"

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "loss", "row", "piece"], ascending=[False, False, True, True])
        slot = pack_block(group["tokens"].to_numpy(), group["loss"].to_numpy(), capacity, segments, loss_limit)
        # the fuller of the sizes in tokens, as tokens of the capacity; one that is full in segments may find larger pieces yet
        fill = np.maximum(np.bincount(slot, group["tokens"]) / capacity, np.bincount(slot, group["loss"]) / max(1, loss_limit))
        return group.assign(slot=slot, position=pd.Series(slot).groupby(slot).cumcount().to_numpy(np.int64), fill=(fill * capacity).astype(np.int64)[slot])

    return keyed.groupBy("block").applyInPandas(pack, schema)


def pack_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int | None = None,
    full: float = 0.98, block: int = BLOCK, vocabulary: str = BYTE_BPE, folder: str = TOKENIZER_DIR,
) -> DataFrame:
    """``(id, piece, first_token, tokens, loss, container, position)`` of every item's pieces.

    ``container`` is a string; ``position`` is the piece's place in it, from 0.
    ``loss_limit`` is the capacity unless given. A container counts as full if it is
    ``full`` in tokens or loss-bearing tokens.
    """
    loss_limit = capacity if loss_limit is None else loss_limit
    sizes = checkpoint(measure(df, id_col, text_col, vocabulary, folder))
    parts = pieces(sizes, capacity, id_col)
    whole = (F.col("tokens") >= full * capacity) | (F.col("loss") > loss_limit)
    alone = parts.where(whole).withColumns({"container": F.concat_ws("-", F.lit("w"), "row", "piece"), "position": F.lit(0).cast("bigint")})
    rest = parts.where(~whole)
    n = rest.count()
    blocks = max(1, -(-n // block))
    done = []
    for number in range(8):
        packed = _round(rest, blocks, number, capacity, segments, loss_limit, id_col)
        last = blocks == 1 or number == 7
        if not last:
            packed = checkpoint(packed)
        kept = packed if last else packed.where(F.col("fill") >= full * capacity)
        done.append(kept.withColumn("container", F.concat_ws("-", F.lit(str(number)), "block", "slot")).drop("block", "slot", "fill"))
        if last:
            break
        rest = packed.where(F.col("fill") < full * capacity).drop("block", "slot", "position", "fill")
        left = rest.count()
        if not left:
            break
        # fewer blocks by a factor, or by what is left; never more pieces in one than twice a block
        blocks = max(1, -(-left // block)) if left > block else 1
    out = alone
    for part in done:
        out = out.unionByName(part)
    empty = sizes.where("tokens = 0").select(id_col, F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("first_token"), "tokens", F.lit(0).cast("bigint").alias("loss"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("bigint").alias("position"))
    return out.select(*empty.columns).unionByName(empty)


def fill(packed: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int | None = None) -> DataFrame:
    """``(containers, pieces, tokens, tokens_full, segments_full, loss_full)``: one row; shares of what the containers could hold, null without any."""
    each = packed.where("container is not null").groupBy("container").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum("loss").alias("l"))
    total = each.agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("l").alias("l"))
    share = lambda part, most: F.try_divide(F.col(part), F.col("c") * most)
    return total.select(
        F.col("c").alias("containers"), F.coalesce("n", F.lit(0)).alias("pieces"), F.coalesce("t", F.lit(0)).alias("tokens"),
        share("t", capacity).alias("tokens_full"), share("n", segments).alias("segments_full"), share("l", capacity if loss_limit is None else loss_limit).alias("loss_full"),
    )
