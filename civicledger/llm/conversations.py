"""Conversation structure repair: cheapest edits to system? (user assistant)+ by Four-Russians block tables."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from civicledger.llm.common import BLANKS, staged

# ---- the edit model ------------------------------------------------------------------------------

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)                # the role that an inserted or rerolled turn must have
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = {"su", "ua", "au"}
DELETE_COST, INSERT_COST, REROLE_COST, OPEN_COST = 4, 3, 3, 3
MUST_GO, INITIALS = 0, "sua?"
SYMBOLS = 1 + 2 * len(INITIALS)                     # a turn that must go; else its initial, whole or cut off
BLOCK = 4
END = (0, 6, 3, 0)                                  # cost from each state when no turn is left


def symbol(initial: str, must_go: bool, cut_off: bool) -> int:
    return MUST_GO if must_go else 1 + 2 * (INITIALS.index(initial) if initial and initial in "sua" else 3) + cut_off


def options(x: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) for a turn of symbol ``x``; insertions are not among them."""
    yield "D", DELETE_COST, state
    if x != MUST_GO:
        initial, more = INITIALS[(x - 1) // 2], OPEN_COST * ((x - 1) % 2)
        if (initial, state) in KEEP:
            yield "K", more, KEEP[initial, state]
        yield "R", REROLE_COST + more, NEXT[state]


def step(x: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cheapest cost from each state before a turn, from the costs behind it."""
    own = [min(c + after[to] for _, c, to in options(x, q)) for q in range(4)]
    u, a = own[USER], own[ASSISTANT]
    u, a = min(u, INSERT_COST + a), min(a, INSERT_COST + u)
    return min(own[START], INSERT_COST + u), min(own[SYSTEM], INSERT_COST + u), u, a


class Tables:
    """Costs to the end, less their minimum, take few values: they are numbered, and for each of them and
    each block of symbols the table has the vector in front of the block and what the minimum grows by."""

    def __init__(self, block: int):
        base = min(END)
        self.vectors, number = [tuple(v - base for v in END)], {}
        number[self.vectors[0]] = 0
        one, grow = [], []
        for v in self.vectors:          # grows while it is walked
            for x in range(SYMBOLS):
                w = step(x, v)
                low = min(w)
                w = tuple(c - low for c in w)
                if w not in number:
                    number[w] = len(self.vectors)
                    self.vectors.append(w)
                one.append(number[w])
                grow.append(low)
        self.base, self.block = base, block
        self.one = np.array(one, np.int32).reshape(-1, SYMBOLS)
        self.one_grow = np.array(grow, np.int32).reshape(-1, SYMBOLS)
        go, cost = self.one, self.one_grow
        for _ in range(block - 1):      # a longer block: its last symbols first, then one in front of them
            front, more = self.one[go], self.one_grow[go]       # [vector, rest, symbol]
            go = front.transpose(0, 2, 1).reshape(len(self.vectors), -1)
            cost = (cost[:, :, None] + more).transpose(0, 2, 1).reshape(len(self.vectors), -1)
        self.go, self.grow = go.tolist(), cost.tolist()


@lru_cache(None)
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def cheapest_edits(symbols: bytes | bytearray, block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit). Whole blocks are looked up from the end to the front, leaving one vector number per
    border; then block after block is expanded backward turn by turn, and walking it forward takes, of
    the edits that are on a cheapest way, the ASCII-least. Memory: a number per block and the audit."""
    t = tables(block)
    full, rest = divmod(len(symbols), block)
    v, total, borders = 0, t.base, []
    for x in reversed(symbols[full * block:]):
        total += int(t.one_grow[v, x])
        v = int(t.one[v, x])
    borders.append(v)
    for k in range(full - 1, -1, -1):
        code = 0
        for x in symbols[k * block:(k + 1) * block]:
            code = code * SYMBOLS + x
        total += t.grow[v][code]
        v = t.go[v][code]
        borders.append(v)
    cost, audit, q = total + t.vectors[v][START], [], START

    def walk(part: bytes | bytearray, right: tuple[int, ...]) -> None:
        nonlocal q
        costs = [right]
        for x in reversed(part):
            costs.append(step(x, costs[-1]))
        for i, x in enumerate(part):
            here, after = costs[len(part) - i], costs[len(part) - i - 1]
            while True:
                ways = [(e, to) for e, c, to in options(x, q) if c + after[to] == here[q]]
                if INSERT_COST + here[NEXT[q]] == here[q]:
                    ways.append(("I", None))
                e, to = min(ways, key=lambda w: w[0])
                audit.append(e)
                if e != "I":
                    q = to
                    break
                q = NEXT[q]

    for k in range(full):
        walk(symbols[k * block:(k + 1) * block], t.vectors[borders[-2 - k]])
    walk(symbols[full * block:], t.vectors[0])
    while END[q]:
        audit.append("I")
        q = NEXT[q]
    return cost, "".join(audit)


def apply_edits(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    q = START
    for e in audit:
        if e == "I":
            q = NEXT[q]
            yield ROLE[q], ""
            continue
        role, text = next(turns)
        if e == "K":
            q = KEEP[role[:1], q]
            yield role, text
        elif e == "R":
            q = NEXT[q]
            yield ROLE[q], text


# ---- rows ------------------------------------------------------------------------------------------

TURN = ["conv_id", "turn", "role", "text", "copies"]
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
DIGEST = SUMMARY + ", repaired_sha256 string"
REPAIRED = "conv_id long, position long, role string, text string"


def as_turns(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): a null role or text is one space, other columns stay behind."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(1).alias("copies"))


def damage(convs: DataFrame) -> DataFrame:
    """Turns with planted faults, chosen by the crc32 of ``conv_id:turn`` (null: one space) modulo 20: 0
    drops the turn, 1 empties it, 2 takes its full stops, 3 repeats it, 4 makes it the user's. A dropped
    turn leaves a row with copies = 0 and no turn, role or text, so that its conversation stays known."""
    t = as_turns(convs)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = t.withColumn("k", F.pmod(F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "UTF-8")), F.lit(20)))
    gone = F.col("k") == 0
    return t.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(F.col("k") == 4, F.lit("user")).when(~gone, F.col("role")).alias("role"),
        F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.translate("text", ".!?", "")).when(~gone, F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("k") == 3, 2).otherwise(1).alias("copies"))


def _marked(turns: DataFrame) -> DataFrame:
    """With ``blank`` and ``cut_off`` (the last visible character ends no sentence)."""
    last = F.substring(F.btrim("text", F.lit(BLANKS)), -1, 1)
    return turns.withColumn("blank", last == "").withColumn("cut_off", ~last.isin("", ".", "!", "?"))


ORDER = ["conv_id", "turn", "role", "text"]     # ascending, null first


class Faults:
    """Counts over the turns of one conversation, given in order; afterwards ``symbols`` has one byte a turn."""

    def __init__(self):
        self.symbols, self.blank, self.duplicate, self.truncated, self.illegal = bytearray(), 0, 0, 0, 0
        self.least = self.most = self.turn = None
        self.turns, self.last = 0, None

    def add(self, turn, initial: str, copies: int, blank: bool, cut_off: bool, first: bool) -> None:
        if turn is not None and turn != self.turn:      # turns come in order
            self.turns, self.turn = self.turns + 1, turn
            self.least, self.most = (turn if self.least is None else self.least), turn
        for k in range(copies):
            again = not blank and not (first and k == 0)
            self.blank += blank
            self.duplicate += again
            self.truncated += not blank and not again and cut_off
            self.illegal += self.last is not None and self.last + initial not in LEGAL
            self.last = initial
            self.symbols.append(symbol(initial, blank or again, cut_off))

    def row(self, conv_id) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        cost, audit = cheapest_edits(self.symbols)
        return {"conv_id": conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
                "cost": cost, "audit": audit}


def _arrow(spec: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in spec.split(", ")])


def _out(rows: Iterator[dict], spec: str, flush_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    schema, held, size = _arrow(spec), [], 0
    for r in rows:
        held.append(r)
        size += 150 + len(r.get("audit") or "") + len(r.get("text") or "")
        if size > flush_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _result(found: dict, turns: Iterator[tuple[str, str]], digest: bool) -> Iterator[dict]:
    if not digest:
        for k, (role, text) in enumerate(apply_edits(found["audit"], turns)):
            yield {"conv_id": found["conv_id"], "position": k, "role": role, "text": text}
        return
    sha, glue = hashlib.sha256(), ""
    for role, text in apply_edits(found["audit"], turns):
        sha.update(f"{glue}{role}:{text}".encode())
        glue = "\n"
    yield found | {"repaired_sha256": sha.hexdigest()}


def _repair_whole(digest: bool):
    """Conversations of bounded size, sorted: one at a time in memory."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            rows = [r for r in rows if r[4]]
            faults, seen = Faults(), set()
            for _, turn, role, text, copies, blank, cut_off in rows:
                faults.add(turn, role[:1], copies, blank, cut_off, (role, text) not in seen)
                seen.add((role, text))
            yield from _result(faults.row(conv_id), ((r[2], r[3]) for r in rows for _ in range(r[4])), digest)
    return lambda batches: _out(each(batches), DIGEST if digest else REPAIRED)


def _audit_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns without their texts, in order: a byte each is held, as in the audit itself."""
    def each() -> Iterator[dict]:
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            faults = Faults()
            for r in rows:
                faults.add(*r[2:])
            yield faults.row(conv_id)
    return _out(each(), SUMMARY)


def _apply_long(digest: bool):
    """Per conversation its audit, then its turns in order, streamed past it."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            found = {"conv_id": conv_id} | next(rows)[5]
            yield from _result(found, ((r[2], r[3]) for r in rows for _ in range(r[4])), digest)
    return lambda batches: _out(each(batches), DIGEST if digest else REPAIRED)


def _repair_long(turns: DataFrame, digest: bool) -> DataFrame:
    """Conversations of any length. Equal turns are counted before they move, sorting and finding each
    turn's first occurrence are spread over all tasks, and no join key is hot: (conversation, turn, hash)
    is unique. Only what the result itself holds meets in one task: a byte per turn for the audit, and
    the repaired text, streamed, where its digest is asked for."""
    hashed = (turns.filter("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
              .withColumn("h", F.sha2(F.encode(F.concat("role", F.lit("\x00"), "text"), "UTF-8"), 256)))
    hashed = staged(_marked(hashed), "long-turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = hashed.groupBy("conv_id", "h").agg(F.min(place).alias("p")).select(F.col("conv_id").alias("c"), F.col("h").alias("g"), F.col("p.turn").alias("t"), F.lit(True).alias("first"))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("g")) & F.col("turn").eqNullSafe(F.col("t"))
    cut = F.substring("text", 1, 1024).asc()      # what range borders are drawn from stays small
    ordered = (hashed.join(first, on, "left").repartitionByRange(*ORDER[:3], cut).sortWithinPartitions(*ORDER)
               .select("conv_id", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", F.col("copies").cast("long").alias("copies"), "blank", "cut_off",
                       F.coalesce("first", F.lit(False)).alias("first")))
    ordered = staged(ordered, "long-ordered")
    by_place = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    light = ordered.select("conv_id", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "copies", "blank", "cut_off", "first")
    audits = staged(by_place(light).mapInArrow(_audit_long, SUMMARY), "long-audits")
    fields = [c.split()[0] for c in SUMMARY.split(", ")][1:]
    heads = audits.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                          F.lit(None).cast("long").alias("copies"), F.struct(*fields).alias("found"))
    rows = heads.unionByName(ordered.select("conv_id", "pos", "role", "text", "copies", F.lit(None).cast(heads.schema["found"].dataType).alias("found")))
    return by_place(rows).mapInArrow(_apply_long(digest), DIGEST if digest else REPAIRED)


def _repair(turns: DataFrame, digest: bool, most_turns: int, most_bytes: int) -> DataFrame:
    sizes = turns.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = staged(sizes.filter((F.col("n") > most_turns) | (F.col("bytes") > most_bytes)).select(F.col("conv_id").alias("c")), "long")
    is_long = F.col("conv_id").eqNullSafe(F.col("c"))
    cols = [*TURN, "blank", "cut_off"]
    whole = _marked(turns.join(long, is_long, "left_anti")).select(*cols).repartition("conv_id").sortWithinPartitions(*ORDER)
    out = whole.mapInArrow(_repair_whole(digest), DIGEST if digest else REPAIRED)
    if long.isEmpty():
        return out
    return out.unionByName(_repair_long(turns.join(long, is_long, "left_semi"), digest))


def repair(turns: DataFrame, most_turns: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """One row per conversation: gaps, fault counts, illegal neighbours, cheapest cost, audit and the
    SHA-256 of the repaired conversation. ``turns`` comes from as_turns() or damage().

    Turns count by number, null first; turns of one number by role, then by text in code-point order. A
    null conv_id is a conversation of its own. Without turns: zeros, an empty audit, the hash of nothing.
    Conversations above ``most_turns`` or ``most_bytes`` are sorted and compared by all tasks together,
    shorter ones one at a time; the rows are the same.
    """
    return _repair(turns, True, most_turns, most_bytes)


def repaired_turns(turns: DataFrame, most_turns: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations themselves, under the same rules."""
    return _repair(turns, False, most_turns, most_bytes)


def op13(convs: DataFrame) -> DataFrame:
    return repair(damage(convs))
