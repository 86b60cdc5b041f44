"""Bit filters of bounded size: they keep rows out of a shuffle early and never decide anything."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PAGE = 15


def bitmap(df: DataFrame, key: str, bits: int):
    """A broadcast array of words of 64 bits, 2^bits bits in all, with the low bits of all keys (long) set."""
    page = max(0, min(_PAGE, bits - 6))

    def build(batches):
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            slot = b.column("slot").to_numpy()
            slot = np.sort(slot)
            cut = np.flatnonzero(np.diff(slot >> page, prepend=-1))
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(slot)]):
                own = pages.setdefault(int(slot[x] >> page), np.zeros(1 << page, bool))
                own[slot[x:y] & ((1 << page) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in pages.values()], pa.binary())], ["page", "bits"])

    slots = df.select(F.expr(f"{key} & {(1 << bits) - 1}L").alias("slot")).repartition(F.shiftright("slot", page))
    out = np.zeros(1 << (bits - page), dtype=f"V{1 << (page - 3)}")
    for r in slots.mapInArrow(build, "page long, bits binary").toLocalIterator():  # 2^bits bits in all
        out[r["page"]] = bytes(r["bits"])
    return df.sparkSession.sparkContext.broadcast(out.view(np.int64))


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set."""
    slot = keys.view(np.int64) & (len(words) * 64 - 1)
    return (words[slot >> 6] >> (slot & 63)) & 1 == 1
