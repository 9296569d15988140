"""Repair of conversations by the cheapest edits, found by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, state of the order of roles): nothing said yet, after a system turn, after a user's,
after an assistant's. Edges keep, rerole or delete the next row, or insert an empty turn. Two heaps, one from the start
and one from the accepting ends, settle nodes in order of cost; they go on until the sum of their least costs exceeds the
best crossing, so that all crossings of that cost are settled. Of these the least concatenated audit wins. Each label is
a cost and the least audit of that cost: two audits of one node and cost never begin one another, so the least of a
whole is made of the least of its parts.

Rows are dealt by conversation and stretch of `stretch` turns, sorted, and read in a stream. A conversation of one
stretch, at most `segment_rows` rows and `segment_bytes` bytes is repaired where it is read. A longer one, however long,
is cut into segments: for each pair of states a segment gives its cheapest edits, and the same search over these, with
a segment as an edge, settles which are taken. Only what must be in order, the hash of the repaired text, is taken in
one task, as a stream of the segments' repaired texts. Which rows repeat an earlier one is found by a join of hashes.

Rows: a null role or text is one space, and so is a null conv_id or turn in the damage's key; rows with a null conv_id are
one conversation; ties of turn are read by role, then by the text's SHA-256; repeated rows are duplicates; very long
texts are read whole; an empty role is none of the initials; an empty table gives an empty result. Numbers of gaps beyond a
long are its largest value. Only the four named columns are read, so others can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.shared import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
#: States: 0 nothing said yet, 1 after system, 2 after user, 3 after assistant. Those in which a conversation may end.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
FINE, MUST_GO, CUT_OFF = 0, 1, 2
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
#: Edges within a layer: (from, to, cost, audit).
INSERTS = tuple((q, r, INSERT, "I") for (q, c), r in NEXT.items() if c in ROLES)


@dataclass(frozen=True)
class Params:
    segment_rows: int = 512
    segment_bytes: int = 4 << 20
    #: Turns of a stretch, as a power of two.
    stretch_bits: int = 9


@cache
def edits(initial: str, fault: int) -> tuple[tuple[int, int, int, str], ...]:
    """Edges (from, to, cost, audit) over a row."""
    found = [(q, q, DELETE, "D") for q in range(4)]
    if fault != MUST_GO:
        more = UNFINISHED if fault == CUT_OFF else 0
        found += [(q, r, REROLE + more, "R") for (q, c), r in NEXT.items() if c in ROLES]
        found += [(q, r, more, "K") for (q, c), r in NEXT.items() if c == initial]
    return tuple(found)


def cheapest(steps: list, start: int, ends: tuple[int, ...], within: tuple = INSERTS) -> tuple[int, str, list] | None:
    """(cost, least audit, its edges) from start before the steps to one of the ends after them; steps: the edges
    of each layer to the next one, within: those that stay in a layer. None where there is no way."""
    n = len(steps)
    # Labels: cost, audit, and the way as (edge, rest).
    labels = ({(0, start): (0, "", None)}, {(n, q): (0, "", None) for q in ends})
    heaps, settled = ([(0, 0, start)], [(0, -n, q) for q in ends]), (set(), set())
    best = float("inf")
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(heaps[1][0][0] < heaps[0][0][0])
        # Of equal costs the node nearer to the heap's own side first: edges without cost lead away from there.
        cost, layer, q = heappop(heaps[side])
        layer = abs(layer)
        if (layer, q) in settled[side]:
            continue
        settled[side].add((layer, q))
        cost, audit, way = labels[side][layer, q]
        if (layer, q) in labels[1 - side]:
            best = min(best, cost + labels[1 - side][layer, q][0])
        at = layer - side
        along = [(e, layer + (-1 if side else 1)) for e in steps[at]] if 0 <= at < n else []
        for edge, to in along + [(e, layer) for e in within]:
            if edge[side] != q:
                continue
            node = (to, edge[1 - side])
            label = (cost + edge[2], edge[3] + audit if side else audit + edge[3], ((min(to, layer), edge), way))
            if node in labels[1 - side]:
                best = min(best, label[0] + labels[1 - side][node][0])
            if node not in labels[side] or label[:2] < labels[side][node][:2]:
                labels[side][node] = label
                heappush(heaps[side], (label[0], -to if side else to, node[1]))
    if best == float("inf"):
        return None

    found = None

    def offer(audit: str, front, middle: list, back) -> None:
        nonlocal found
        if found is None or audit < found[1]:
            found = (best, audit, (front, middle, back))

    # The labels of the two ends of a way are known without being settled.
    front_nodes, back_nodes = settled[0] | {(0, start)}, settled[1] | {(n, q) for q in ends}
    for layer, q in front_nodes:
        cost, audit, front = labels[0][layer, q]
        if (layer, q) in back_nodes and cost + labels[1][layer, q][0] == best:
            offer(audit + labels[1][layer, q][1], front, [], labels[1][layer, q][2])
        ahead = [(e, layer + 1) for e in steps[layer]] if layer < n else []
        for edge, to in ahead + [(e, layer) for e in within]:
            node = (to, edge[1])
            if edge[0] == q and node in back_nodes and cost + edge[2] + labels[1][node][0] == best:
                offer(audit + edge[3] + labels[1][node][1], front, [(layer, edge)], labels[1][node][2])
    front, middle, back = found[2]
    way = []
    while front is not None:
        way.append(front[0])
        front = front[1]
    way = way[::-1] + middle
    while back is not None:
        way.append(back[0])
        back = back[1]
    return found[0], found[1], way


def repaired(rows: list[tuple[str, str]], audit: str, state: int = 0) -> list[str]:
    """Lines role:text that the audit leaves of the rows (role, text), from a state on."""
    found, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else "u" if (state, "u") in NEXT else "a"
        state = NEXT[state, initial]
        found.append(f"{role if edit == 'K' else ROLES[initial]}:{text}")
    return found


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, gone, copies, role, text) after the damage that crc32(conv_id:turn) % 20 calls for."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), harm.alias("harm"), text("role").alias("role"), text("text").alias("text"))
    return rows.select(
        "conv_id",
        "turn",
        (F.col("harm") == 0).alias("gone"),
        F.when(F.col("harm") == 3, 2).otherwise(1).alias("copies"),
        F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
    )


def joined(left: DataFrame, right: DataFrame, names: tuple[str, ...], how: str = "inner") -> DataFrame:
    """left joined to right where the named columns agree, nulls with nulls; the columns of both, those once."""
    other = right.withColumnsRenamed({n: f"right_{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"right_{n}"))
    return left.join(other, on, how).drop(*(f"right_{n}" for n in names))


#: What a row of the stream is.
LONG, REPEATED, LIVE, GONE = 0, 1, 2, 3
STREAM = ("conv_id", "stretch", "turn", "kind", "copies", "role", "hash", "text")


def stream(rows: DataFrame, params: Params) -> DataFrame:
    """The rows in order, those of a conversation's stretch in one partition. Before a stretch of a long
    conversation comes a row that says so; before a row that repeats one of an earlier turn, one that says so."""
    stretch = F.shiftright("turn", params.stretch_bits)
    rows = rows.withColumn("stretch", stretch).withColumn("hash", F.unhex(F.sha2("text", 256)))
    none = F.lit(None)
    live = rows.filter("not gone").select("conv_id", "turn", "stretch", "role", "hash")
    first = live.groupBy("conv_id", "role", "hash").agg(F.min(F.struct("turn")).alias("lo"), F.max(F.struct("turn")).alias("hi")).filter("lo <> hi").drop("hi")
    again = joined(live, first, ("conv_id", "role", "hash")).filter(F.struct("turn") > F.col("lo")).drop("lo").distinct()
    about = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.octet_length("text")).alias("bytes"), F.min(F.struct("stretch")).alias("lo"), F.max(F.struct("stretch")).alias("hi"))
    long = about.filter((F.col("n") > params.segment_rows) | (F.col("bytes") > params.segment_bytes) | (F.col("lo") != F.col("hi"))).select("conv_id")
    parts = joined(rows.select("conv_id", "stretch").distinct(), long, ("conv_id",), "left_semi")
    given = [
        rows.select("conv_id", "stretch", "turn", F.when(F.col("gone"), GONE).otherwise(LIVE).alias("kind"), "copies", "role", F.when(~F.col("gone"), F.col("hash")).alias("hash"), F.when(~F.col("gone"), F.col("text")).alias("text")),
        again.select("conv_id", "stretch", "turn", F.lit(REPEATED).alias("kind"), F.lit(0).alias("copies"), "role", "hash", none.cast("string").alias("text")),
        parts.select("conv_id", "stretch", none.cast("long").alias("turn"), F.lit(LONG).alias("kind"), F.lit(0).alias("copies"), none.cast("string").alias("role"), none.cast("binary").alias("hash"), none.cast("string").alias("text")),
    ]
    every = given[0].unionByName(given[1]).unionByName(given[2])
    lead = F.when(F.col("kind") == LONG, 0).otherwise(1)
    return every.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", lead, "turn", "role", "hash", "kind").select(*STREAM)


@dataclass
class Segment:
    """Consecutive rows of a conversation, and what is counted over them."""

    rows: list = field(default_factory=list)
    kinds: list = field(default_factory=list)
    bytes: int = 0
    lo: int | None = None
    hi: int | None = None
    distinct: int = 0
    counts: list = field(default_factory=lambda: [0, 0, 0])
    illegal: int = 0

    def add(self, role: str, text: str, fault: int, counted: int | None) -> None:
        initial = role[:1]
        self.illegal += bool(self.rows) and self.rows[-1][0][:1] + initial not in ("su", "ua", "au")
        self.rows.append((role, text))
        self.kinds.append((initial if initial in ("s", "u", "a") else "", fault))
        self.bytes += len(text)
        if counted is not None:
            self.counts[counted] += 1

    def steps(self) -> list:
        return [edits(*k) for k in self.kinds]


#: Pairs of states of a segment, in the order of its arrays.
PAIRS = [(q, r) for q in range(4) for r in range(4)]
FOUND = (
    "conv_id long, stretch long, seq long, is_long boolean, lo long, hi long, distinct long, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, cost long, audit string, repaired_sha256 string, costs array<long>, audits array<string>, roles array<string>, texts array<string>"
)
NAMES = [c.split()[0] for c in FOUND.split(", ")]


def row_of(key: tuple, seq: int, long: bool, s: Segment) -> tuple:
    head = (*key, seq, long, s.lo, s.hi, s.distinct, *s.counts, s.illegal, s.rows[0][0][:1] if s.rows else None, s.rows[-1][0][:1] if s.rows else None)
    if long:
        ways = [cheapest(s.steps(), q, (r,)) for q, r in PAIRS]
        return (*head, None, None, None, [w and w[0] for w in ways], [w and w[1] for w in ways], [r for r, _ in s.rows], [t for _, t in s.rows])
    cost, audit, _ = cheapest(s.steps(), 0, ENDS)
    lines = repaired(s.rows, audit)
    return (*head, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), None, None, None, None)


def segments(params: Params):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, seq, long, seg, turn, before, repeated = None, 0, False, Segment(), None, None, None
        for batch in batches:
            for conv, stretch, at, kind, copies, role, digest, text in zip(*(batch.column(n).to_pylist() for n in STREAM)):
                if key != (conv, stretch):
                    if key is not None:
                        yield row_of(key, seq, long, seg)
                    key, seq, long, seg, turn, before, repeated = (conv, stretch), 0, False, Segment(), (), None, None
                if kind == LONG:
                    long = True
                elif kind == REPEATED:
                    repeated = (at, role, digest)
                elif kind == LIVE:
                    if turn != (at,):
                        turn, before = (at,), None
                        if at is not None:
                            seg.distinct += 1
                            seg.lo, seg.hi = at if seg.lo is None else seg.lo, at
                    left = text.rstrip(SPACE)
                    for _ in range(copies):
                        if long and seg.rows and (len(seg.rows) >= params.segment_rows or seg.bytes + len(text) > params.segment_bytes):
                            yield row_of(key, seq, long, seg)
                            seq, seg = seq + 1, Segment()
                        if not left:
                            seg.add(role, text, MUST_GO, 0)
                        elif before == (role, digest) or repeated == (at, role, digest):
                            seg.add(role, text, MUST_GO, 1)
                        elif left[-1] not in ".!?":
                            seg.add(role, text, CUT_OFF, 2)
                        else:
                            seg.add(role, text, FINE, None)
                        before = (role, digest)
        if key is not None:
            yield row_of(key, seq, long, seg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(n, types[c.split()[1]]) for n, c in zip(NAMES, FOUND.split(", "))])
        held, size = [], 0
        for row in read(batches):
            held.append(row)
            size += 1 + sum(map(len, row[-1] or ()))
            if size > 1 << 22 or len(held) >= 2000:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in held], schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in held], schema)

    return run


CHOSEN = "conv_id long, stretch long, seq long, state int, piece string, total boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def chosen(own: pd.DataFrame) -> pd.DataFrame:
    """For the segments of a conversation the state each begins in and its audit, and one row with the totals."""
    own = own.astype(object).where(own.notna(), None)
    own = own.assign(at=[(s is not None, s or 0) for s in own["stretch"]]).sort_values(["at", "seq"])
    steps = [[(q, r, int(c), a) for (q, r), c, a in zip(PAIRS, costs, audits) if c is not None and c == c] for costs, audits in zip(own["costs"], own["audits"])]
    cost, audit, way = cheapest(steps, 0, ENDS, within=())
    told = own[own["first"].notna()]
    seams = sum(a + b not in ("su", "ua", "au") for a, b in zip(told["last"].iloc[:-1], told["first"].iloc[1:]))
    los, his = own["lo"].dropna(), own["hi"].dropna()
    gaps = min(int(his.max()) - int(los.min()) + 1 - int(own["distinct"].sum()), (1 << 63) - 1) if len(los) else 0
    conv = own["conv_id"].iloc[0]
    rows = [(conv, s, n, e[0], e[3], False, *[None] * 7) for s, n, (_, e) in zip(own["stretch"], own["seq"], way)]
    sums = [int(own[c].sum()) for c in ("blank", "duplicate", "truncated")]
    rows.append((conv, None, None, None, None, True, gaps, *sums, int(own["illegal"].sum()) + seams, cost, audit))
    found = pd.DataFrame(rows, columns=[c.split()[0] for c in CHOSEN.split(", ")])
    return found.astype({c.split()[0]: "Int64" for c in CHOSEN.split(", ") if c.split()[1] in ("long", "int")})


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, stretch, seq and the repaired text of a segment, null where no row is left."""
    for batch in batches:
        for row in batch.to_pylist():
            lines = repaired(list(zip(row["roles"], row["texts"])), row["piece"], row["state"])
            text = pa.array(["\n".join(lines) if lines else None], pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array([row[n]], pa.int64()) for n in ("conv_id", "stretch", "seq")), text], names=["conv_id", "stretch", "seq", "text"])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and the hash over the texts of its segments, which come in order."""

    def out(conv, sha) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    now = None
    for batch in batches:
        for conv, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if now is None or now[0] != conv:
                if now:
                    yield out(*now[:2])
                now = [conv, hashlib.sha256(), False]
            if text.is_valid:
                now[1].update((b"\n" if now[2] else b"") + text.as_py().encode())
                now[2] = True
    if now:
        yield out(*now[:2])


RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """A row for each conversation of rows as `damaged` gives them: what is wrong with it, the cheapest edits, and the
    hash of the repaired conversation."""
    found = cut_lineage(stream(rows, params).mapInArrow(segments(params), FOUND))
    gaps = F.when(F.col("lo").isNull(), F.lit(0)).otherwise(F.least(F.col("hi").cast("decimal(38,0)") - F.col("lo") + 1 - F.col("distinct"), F.lit((1 << 63) - 1)).cast("long")).cast("long")
    short = found.filter("not is_long").withColumn("gaps", gaps).select(*RESULT)
    parts = found.filter("is_long")
    narrow = parts.drop("roles", "texts", "cost", "audit", "repaired_sha256", "is_long")
    choice = cut_lineage(narrow.groupBy("conv_id").applyInPandas(chosen, CHOSEN))
    taken, totals = choice.filter("not total"), choice.filter("total")
    pieces = joined(parts.select("conv_id", "stretch", "seq", "roles", "texts"), taken.select("conv_id", "stretch", "seq", "state", "piece"), ("conv_id", "stretch", "seq"))
    texts = pieces.mapInArrow(texts_of, "conv_id long, stretch long, seq long, text string")
    hashes = texts.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "seq").select("conv_id", "text").mapInArrow(hashed, "conv_id long, repaired_sha256 string")
    long = joined(totals, hashes, ("conv_id",)).select(*RESULT)
    return short.unionByName(long)
