"""Chains of kept versions, followed in parallel however long and slow one history is.

A version is kept when some field is at least its tolerance away from the last kept one, so each row has one
successor: the next row outside the tolerance around it. The kept versions are the chain of successors from the
first row. Histories are cut into blocks of consecutive rows; a successor outside the own block is found by
descending from the extremes of groups of blocks to those of a block and to its rows. Pointers between blocks
are then doubled, which marks the rows where the chain leaves a block in a logarithmic number of rounds, and
every block the chain enters is followed by itself.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from civicledger.sources.sinks import staged

WIDTH = 1024      # rows of a block, and blocks of a group


def kept_rows(values: np.ndarray, last: np.ndarray | None, tol: np.ndarray) -> tuple[list[int], np.ndarray | None]:
    """Numbers of the rows that are kept, in order, and the last kept values. The next row outside the
    tolerance is found by searching ever longer blocks, so rows that change nothing are passed over at once."""
    kept, at = [], 0
    while at < len(values):
        if last is not None:
            size = 16
            while at < len(values):
                outside = (np.abs(values[at:at + size] - last) >= tol).any(1)
                if outside.any():
                    at += int(outside.argmax())
                    break
                at, size = at + size, size * 2
            else:
                break
        kept.append(at)
        last, at = values[at], at + 1
    return kept, last


def first_outside(values: np.ndarray, low: np.ndarray, high: np.ndarray, tol: np.ndarray, after: np.ndarray | int) -> np.ndarray:
    """For each value the first box behind number ``after`` that holds a row outside its tolerance, or -1.
    Subtraction is monotone, so the extremes of a box decide exactly; a missing number is never outside."""
    out = np.zeros((len(values), len(low)), bool)
    with np.errstate(invalid="ignore"):
        for f, t in enumerate(tol):
            v = values[:, f, None]
            out |= (high[None, :, f] - v >= t) | (v - low[None, :, f] >= t)
    out &= np.arange(len(low)) > np.reshape(after, (-1, 1))
    return np.where(out.any(1), out.argmax(1), -1)


def _cut(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with the block they lie in and their place there. Blocks are numbered along the order; a project
    of any size is spread by its order columns."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, place, last = TaskContext.get().partitionId() << 33, -1, None        # of the row before
        for pdf in batches:
            k = pdf[key]
            fresh = ((k != k.shift()) & ~(k.isna() & k.shift().isna())).to_numpy(bool, na_value=True)
            if len(pdf):
                fresh[0] = place >= 0 and not (k.iat[0] == last or (pd.isna(k.iat[0]) and pd.isna(last)))
            at = np.arange(len(pdf))
            begin = np.maximum.accumulate(np.where(fresh, at, -1))
            run = np.where(begin < 0, at + place + 1, at - begin)                  # place in the key's rows since the block before was full
            blocks = block + np.cumsum(fresh | ((run % WIDTH == 0) & (run > 0)))
            if len(pdf):
                block, place, last = int(blocks[-1]), int(run[-1] % WIDTH), k.iat[-1]
            yield pdf.assign(block=blocks.astype(np.int64), place=(run % WIDTH).astype(np.int32))

    return rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInPandas(number, types + ", block bigint, place int")


def _boxes(df: DataFrame, by: list[str], names: list[str], number: str) -> DataFrame:
    """The extremes of at most ``WIDTH`` parts as one packed row (of all groups of a key: a row of one part in a million rows)."""
    low, high = [f"lo_{f}" for f in names], [f"hi_{f}" for f in names]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(number)
        row = {c: [pdf[c].iloc[0]] for c in by}
        return pd.DataFrame({**row, "low": [pdf[low].to_numpy(float).tobytes()], "high": [pdf[high].to_numpy(float).tobytes()]})

    types = dict(df.dtypes)
    return df.groupBy(*by).applyInPandas(pack, ", ".join(f"`{c}` {types[c]}" for c in by) + ", low binary, high binary")


def _descend(df: DataFrame, tol: np.ndarray) -> DataFrame:
    """Deals out the packed values (``ids``, ``vals``) of a block to the parts that hold their next row outside:
    one row per part met (``child``), -1 for none. Parts are searched behind number ``after``."""
    keep = ["source", "home", "g"]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                ids, (vals, low, high) = np.frombuffer(r.ids, np.int32), (np.frombuffer(x, float).reshape(-1, len(tol)) for x in (r.vals, r.low, r.high))
                child = first_outside(vals, low, high, tol, r.after)
                for c in np.unique(child):
                    out.append((r.source, r.home, r.g, int(c), ids[child == c].tobytes(), vals[child == c].tobytes()))
            yield pd.DataFrame(out, columns=[*keep, "child", "ids", "vals"])

    return df.select(*keep, "ids", "vals", "low", "high", "after").mapInPandas(deal, "source bigint, home bigint, g int, child int, ids binary, vals binary")


def _blocks(rows: DataFrame, names: list[str], tol: np.ndarray) -> DataFrame:
    """One packed row per block: its values, where the chain through each row leaves it, and the rows whose successor lies outside."""
    def pack(source: int, home: int, no: int, v: np.ndarray) -> tuple:
        nxt = first_outside(v, v, v, tol, np.arange(len(v)))
        leave = np.arange(len(v), dtype=np.int32)
        for i in np.flatnonzero(nxt >= 0)[::-1]:
            leave[i] = leave[nxt[i]]
        far = np.flatnonzero(nxt < 0).astype(np.int32)
        return source, home, no, v.tobytes(), leave.tobytes(), far.tobytes(), v[far].tobytes(), source * WIDTH + int(leave[0])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["source", "home", "no", "low", "leave", "ids", "vals", "first_leave"]
        head, parts = None, []
        for pdf in batches:
            block, v, out = pdf["block"].to_numpy(), pdf[names].to_numpy(float), []
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(pdf)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                if head is not None and head[0] != block[lo]:
                    out.append(pack(*head, np.concatenate(parts)))
                    parts = []
                head = (int(block[lo]), int(pdf["home"].iat[lo]), int(pdf["no"].iat[lo]))
                parts.append(v[lo:hi])
            yield pd.DataFrame(out, columns=cols)
        if head is not None:
            yield pd.DataFrame([pack(*head, np.concatenate(parts))], columns=cols)

    return (rows.sortWithinPartitions("block", "place").select("block", "home", "no", *names)
            .mapInPandas(gather, "source bigint, home bigint, no int, low binary, leave binary, ids binary, vals binary, first_leave bigint"))


def _edges(df: DataFrame, tol: np.ndarray) -> DataFrame:
    """(node, entry, next): from a row that leaves its block to the row it enters and on to where that block is left."""
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [np.empty((0, 3), np.int64)]
            for r in pdf.itertuples(index=False):
                ids, vals, low = np.frombuffer(r.ids, np.int32).astype(np.int64), *(np.frombuffer(x, float).reshape(-1, len(tol)) for x in (r.vals, r.low))
                at = first_outside(vals, low, low, tol, -1)
                out.append(np.stack([r.source * WIDTH + ids, r.target * WIDTH + at, r.target * WIDTH + np.frombuffer(r.leave, np.int32).astype(np.int64)[at]], 1))
            yield pd.DataFrame(np.concatenate(out), columns=["node", "entry", "next"])

    return df.select("source", "ids", "vals", "target", "low", "leave").mapInPandas(meet, "node bigint, entry bigint, next bigint")


def _entries(several: DataFrame, summary: DataFrame, names: list[str], tol: np.ndarray) -> DataFrame:
    """(block, start) of all blocks that the chain of a longer history enters."""
    summary = summary.withColumn("g", (F.col("no") / WIDTH).cast("int"))
    blocks = staged(_blocks(several, names, tol), "chain-blocks")
    groups = staged(_boxes(summary, ["home", "g"], names, "no"), "chain-groups")
    tops = _boxes(summary.groupBy("home", "g").agg(*[F.min(f"lo_{f}").alias(f"lo_{f}") for f in names], *[F.max(f"hi_{f}").alias(f"hi_{f}") for f in names]),
                  ["home"], names, "g")
    far = blocks.select("source", "home", "ids", "vals", "no", (F.col("no") / WIDTH).cast("int").alias("g"))
    cols = ["source", "home", (F.col("g") * WIDTH + F.col("child")).alias("no"), "ids", "vals"]
    near = staged(_descend(far.join(groups, ["home", "g"]).withColumn("after", F.col("no") % WIDTH), tol), "chain-near")
    beyond = _descend(near.filter("child < 0").drop("child").join(tops, "home").withColumn("after", F.col("g")), tol).filter("child >= 0")
    beyond = beyond.drop("g").withColumnRenamed("child", "g").join(groups, ["home", "g"])
    meets = near.filter("child >= 0").select(*cols).unionByName(_descend(beyond.withColumn("after", F.lit(-1)), tol).select(*cols))
    target = blocks.select("home", "no", F.col("source").alias("target"), "low", "leave")
    edges = staged(_edges(meets.join(target, ["home", "no"]), tol), "chain-edges")

    roots = blocks.filter("no = 0").select(F.col("first_leave").alias("node"))
    reached = edges.select(F.col("next").alias("node")).distinct().unionByName(roots)
    jumps, marked = edges.join(reached, "node", "left_semi").select("node", "next"), roots
    rounds = int(np.ceil(np.log2(summary.agg(F.max("no")).first()[0] + 1)))
    for _ in range(rounds):
        jumps = staged(jumps, "chain-jumps")
        marked = staged(marked.unionByName(marked.join(jumps, "node").select(F.col("next").alias("node"))), "chain-marked")
        jumps = jumps.join(jumps.select(F.col("node").alias("next"), F.col("next").alias("over")), "next").select("node", F.col("over").alias("next"))
    entered = marked.join(edges, "node").select("entry")
    entry = F.col("entry")
    return (entered.select(F.floor(entry / WIDTH).alias("block"), (entry % WIDTH).cast("int").alias("start"))
            .unionByName(blocks.filter("no = 0").select(F.col("source").alias("block"), F.lit(0).alias("start"))))


def follow(rows: DataFrame, key: str, order: list[str], fields: dict[str, float]) -> DataFrame:
    """The kept rows of each key's history: key, order columns and fields. A null key is a key like any other; a
    missing field is never outside its tolerance; of rows that tie in all order columns any may come first."""
    names, tol = list(fields), np.array(list(fields.values()), float)
    out = [key, *order, *names]
    rows = staged(_cut(rows.select(*out), key, order), "chain-rows")
    number = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    summary = rows.groupBy("block").agg(F.first(key).alias("__key"), *[F.min(number(f)).alias(f"lo_{f}") for f in names], *[F.max(number(f)).alias(f"hi_{f}") for f in names])
    whole = Window.partitionBy("__key")
    summary = summary.withColumns({"no": F.row_number().over(whole.orderBy("block")) - 1, "home": F.min("block").over(whole), "__n": F.count(F.lit(1)).over(whole)})
    summary = staged(summary.drop("__key"), "chain-summary")
    starts = summary.filter("__n = 1").select("block", F.lit(0).alias("start"))
    longer = summary.filter("__n > 1")
    if not longer.isEmpty():
        several = rows.repartition("block").join(longer.select("block", "home", "no"), "block")
        starts = starts.unionByName(_entries(several, longer, names, tol))
    d = rows.repartition("block").join(starts, "block").filter("place >= start").sortWithinPartitions("block", "place")
    types = dict(rows.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_block, state = None, None
        for pdf in batches:
            blocks, vals = pdf["block"].to_numpy(), pdf[names].to_numpy(float)
            edges = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(pdf) else np.empty(0, int)
            keep = np.zeros(len(pdf), bool)
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(pdf)]):
                kept, state = kept_rows(vals[lo:hi], state if blocks[lo] == last_block else None, tol)
                keep[[lo + r for r in kept]], last_block = True, blocks[lo]
            yield pdf.loc[keep, out]

    return d.select("block", *out).mapInPandas(fold, ", ".join(f"`{c}` {types[c]}" for c in out))
