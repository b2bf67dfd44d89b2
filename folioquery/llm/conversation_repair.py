"""Conversation structure repair by grammar-compressed dynamic programming.

A conversation is repaired by the cheapest edits after which its roles read `(s?(ua)+)?` by their first
letters: an optional system turn, then pairs of user and assistant. For the edits a row is one of nine
symbols (whether it must go, its role, whether its text is cut off), and a symbol is a min-plus matrix
over the four states of that language: entry (p, q) holds the cost and the audit of the cheapest edits
that take the row from p to q, insertions before it included. Matrices multiply along the
conversation. Re-Pair finds the pairs of symbols that come up again in the conversations of a batch and names
them by rules; each rule's matrix is computed once, from the bottom up, and shared by all conversations.
Audits are ropes, so that a rule's text is shared as well.

Two scripts of equal cost between the same states never are prefixes of one another (the rest would be
insertions, which cost), so the least audit of a product is the product of least audits, and
rows may be multiplied in any grouping. A conversation of any length is therefore cut into segments
that many tasks multiply; only its matrices meet, in order. Rows that are equal in turn, role and text are
one row with a number; the copies are a run of deletions, multiplied by doubling.

Damage, faults, edits and costs: see `damage`, `faults` and `edit_matrix`. Nulls count as one space. Rows of
one turn are ordered by role and then by the SHA-256 of the text. Rows without conv_id are one conversation.
A role other than s, u, a (by first letter) can only be changed or deleted. The repaired text is hashed
as a stream, so a conversation needs no memory but for its audit. A conversation without rows after the
damage has zeros, an empty audit and the hash of nothing. An empty table gives no rows. Only conv_id, turn, role and text
are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioquery.session import materialize

WORD = r"[^\x20\x09-\x0D]"
ENDS = ".!?"
ROLES = "sua"  # first letters; a fourth kind is any other
ROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 2, 3, 2, 1
SEGMENT = 4096  # symbols of one matrix product
BATCH = 40_000  # symbols whose pairs are counted together
LEAF = 48  # characters of an audit that are one string; longer ones are ropes
RANGE_ROWS = 200_000  # rows of a sorted range

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role in a state; None where the role may not stand.
NEXT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
DELETED = 0  # symbol of a row that must go; others are 1 + 2 * role + cut off
SYMBOLS = 9
PAIRS = ("su", "ua", "au")  # letters that may stand side by side

Rope = Any  # a string, or (length, left, right)
Matrix = list  # [4][4] of (cost, rope) or None


def length(rope: Rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[0]


def join(left: Rope, right: Rope) -> Rope:
    size = length(left) + length(right)
    if size <= LEAF:
        return flat(left) + flat(right)
    if not length(left):
        return right
    return (size, left, right) if length(right) else left


def flat(rope: Rope) -> str:
    """The text of a rope."""
    if isinstance(rope, str):
        return rope
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += [top[2], top[1]]
    return "".join(out)


def less(a: Rope, b: Rope) -> bool:
    """Whether the text of a comes before that of b; what both share is skipped unread."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        while x is not y and not (isinstance(x, str) and isinstance(y, str)):
            if not isinstance(x, str) and (isinstance(y, str) or x[0] >= y[0]):
                left.append(x[2])
                x = x[1]
            else:
                right.append(y[2])
                y = y[1]
        if x is y:
            continue
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        if len(x) > n:
            left.append(x[n:])
        if len(y) > n:
            right.append(y[n:])
    return not left and bool(right)


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    """The cheaper of two scripts, of equally cheap ones the first in ASCII order."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if less(b[1], a[1]) else a


def vector_times(vector: list, matrix: Matrix) -> list:
    out: list = [None] * 4
    for p, first in enumerate(vector):
        if first is None:
            continue
        for q, then in enumerate(matrix[p]):
            if then is None:
                continue
            cost = first[0] + then[0]
            if out[q] is None or cost <= out[q][0]:
                out[q] = better(out[q], (cost, join(first[1], then[1])))
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    return [vector_times(row, b) for row in a]


def insertions() -> Matrix:
    """Cheapest insertions between two rows; what a state can reach, it reaches in one way."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for p in range(4):
        state, text = p, ""
        while out[p][state] is None:
            out[p][state] = (INSERT_COST * len(text), text)
            state, text = NEXT[state, 2 if state == USER else 1], text + "I"
    return out


def edit_matrix(symbol: int) -> Matrix:
    """One row: delete it, keep it, or make it a user's or an assistant's; insertions come before it."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    role, cut = divmod(symbol - 1, 2)
    for p in range(4):
        out[p][p] = (DELETE_COST, "D")
        if symbol == DELETED:
            continue
        for new, cost, text in ((role, 0, "K"), (1, ROLE_COST, "R"), (2, ROLE_COST, "R")):
            if (q := NEXT.get((p, new))) is not None:
                out[p][q] = better(out[p][q], (cost + CUT_COST * cut, text))
    return times(insertions(), out)


def result_of(vector: list) -> tuple[int, Rope]:
    """Cheapest script that ends with nothing or after an assistant."""
    ends = vector_times(vector, insertions())
    return better(ends[START], ends[ASSISTANT])


def re_pair(sequences: list[np.ndarray], first: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Sequences with their most frequent neighbours replaced by rules first, first + 1, ...; the rules.

    Goes on until no pair comes twice. Places that overlap (a a a) are taken from the left.
    """
    rules: list[tuple[int, int]] = []
    if not sequences:
        return sequences, rules
    flow = np.concatenate([np.r_[s, -1] for s in sequences]).astype(np.int64)  # -1 ends a sequence
    while len(flow) > 1:
        pairs = flow[:-1] << 32 | flow[1:]
        found, counts = np.unique(pairs[(flow[:-1] >= 0) & (flow[1:] >= 0)], return_counts=True)
        if not len(found) or counts.max() < 2:
            break
        pair = found[counts.argmax()]
        at = np.flatnonzero(pairs == pair)
        if pair >> 32 == pair & 0xFFFFFFFF:  # places that overlap take turns from the left
            turn = np.arange(len(at))
            turn -= np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, turn, 0))
            at = at[turn % 2 == 0]
        flow[at] = first + len(rules)
        flow = np.delete(flow, at + 1)
        rules.append((int(pair >> 32), int(pair & 0xFFFFFFFF)))
    ends = np.flatnonzero(flow < 0)
    return [flow[a:b] for a, b in zip(np.r_[0, ends[:-1] + 1], ends, strict=True)], rules


class Products:
    """Matrices of symbols, of runs of deletions and of the rules of a batch."""

    def __init__(self) -> None:
        self.base = [edit_matrix(s) for s in range(SYMBOLS)]
        #: Symbols from SYMBOLS on stand for 2, 4, 8 ... deletions.
        while len(self.base) < SYMBOLS + 40:
            last = self.base[-1] if len(self.base) > SYMBOLS else self.base[DELETED]
            self.base.append(times(last, last))

    def of(self, sequences: list[tuple[int, ...]]) -> dict[tuple[int, ...], Matrix]:
        """The product of every different sequence."""
        distinct = sorted(set(sequences))
        short, rules = re_pair([np.array(s, np.int64) for s in distinct], len(self.base))
        known = list(self.base)
        for left, right in rules:
            known.append(times(known[left], known[right]))
        out = {}
        for sequence, symbols in zip(distinct, short, strict=True):
            product = known[symbols[0]]
            for symbol in symbols[1:].tolist():
                product = times(product, known[symbol])
            out[sequence] = product
        return out


def run_of_deletions(n: int) -> list[int]:
    return [SYMBOLS - 1 + bit if bit else DELETED for bit in range(n.bit_length()) if n >> bit & 1]


def damage(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> conv_id, turn, role, text, copies.

    By crc32 of `conv_id:turn` modulo 20: 0 drops the row (0 copies), 1 empties the text, 2 takes out
    `[.!?]`, 3 repeats the row (2 copies), 4 makes the role user. Nulls count as one space.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ENDS, "")).otherwise(blank("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(blank("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, digest, blank, cut, copies) -> one row per turn, role and text, with `seen`.

    `seen`: an earlier turn of the conversation has the same role and text. The first such turn is an aggregate
    that combines before the exchange, and only texts that come at two turns are joined back.
    """
    same = ["conv_id", "role", "digest"]
    merged = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")
    )
    order = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    merged = materialize(merged, "repair-rows")
    first = merged.groupBy(*same).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    first = first.select(*(F.col(c).alias(f"_{c}") for c in same), "first")
    equal = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    later = F.col("first").isNotNull() & (order > F.col("first"))
    return merged.join(first, equal, "left").select(*merged.columns, later.alias("seen"))


STATS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]
KEYS = ["conv_id", "turn", "role", "digest"]


def segments(rows: DataFrame) -> DataFrame:
    """Rows with faults, sorted by range over all tasks -> a row per conversation and segment: its counts and matrix.

    A conversation may lie in several ranges, so that its length does not bind it to one task.
    """
    conv_field, turn_field = rows.schema["conv_id"].dataType, rows.schema["turn"].dataType
    types = {
        "conv_id": conv_field.simpleString(), "turn": turn_field.simpleString(), "role": "string", "digest": "string",
        "lowest": turn_field.simpleString(), "last_turn": turn_field.simpleString(), "first_role": "string", "last_role": "string", **dict.fromkeys(STATS, "long"), "costs": "array<long>", "audits": "array<string>",
    }
    schema = ", ".join(f"{n} {t}" for n, t in types.items())
    turn_type = to_arrow_type(turn_field)
    arrow = [to_arrow_type(conv_field), turn_type, pa.string(), pa.string(), turn_type, turn_type, pa.string(), pa.string()]
    arrow += [pa.int64()] * len(STATS) + [pa.list_(pa.int64()), pa.list_(pa.string())]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = Products()
        done: list[tuple[dict, list[int]]] = []  # keys and counts, symbols
        held = 0

        def out() -> pa.RecordBatch:
            found = products.of([tuple(symbols) for _, symbols in done])
            columns: list[list] = [[] for _ in types]
            for own, symbols in done:
                cells = [cell for row in found[tuple(symbols)] for cell in row]
                costs, audits = [c and c[0] for c in cells], [c and flat(c[1]) for c in cells]
                for column, name in zip(columns, types, strict=True):
                    column.append(costs if name == "costs" else audits if name == "audits" else own[name])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], list(types))

        own: dict[str, Any] = {}
        symbols: list[int] = []
        here: Any = ()
        for batch in batches:
            names = [*KEYS, "n", "blank", "cut", "seen"]
            for conv, turn, role, digest, n, blank, cut, seen in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                letter = role[:1]
                if (conv,) != here or len(symbols) >= SEGMENT:
                    if symbols:
                        done.append((own, symbols))
                        held += len(symbols)
                    if held >= BATCH:
                        yield out()
                        done, held = [], 0
                    here, symbols = (conv,), []
                    own = dict.fromkeys(STATS, 0) | dict(zip(KEYS, (conv, turn, role, digest), strict=True))
                    own |= {"lowest": turn, "last_turn": turn, "first_role": letter, "last_role": letter, "turns": int(turn is not None)}
                else:
                    own["turns"] += turn is not None and turn != own["last_turn"]
                    own["illegal"] += own["last_role"] + letter not in PAIRS
                    own["lowest"] = turn if own["lowest"] is None else own["lowest"]
                    own["last_turn"], own["last_role"] = turn, letter
                own["rows"] += n
                own["illegal"] += n - 1  # a role beside itself
                if blank:
                    own["blank"] += n
                elif seen:
                    own["duplicate"] += n
                else:
                    own["duplicate"] += n - 1
                    own["truncated"] += cut
                    symbols.append(1 + 2 * (ROLES.index(letter) if letter and letter in ROLES else 3) + cut)
                    n -= 1
                symbols += run_of_deletions(n)
        if symbols:
            done.append((own, symbols))
        if done:
            yield out()

    ranges = max(1, -(-rows.count() // RANGE_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartitionByRange(ranges, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(multiply, schema)


def combine(parts: DataFrame, ranges: int) -> DataFrame:
    """The segments of each conversation in order -> conv_id, counts, gaps, cost, audit; a row per conversation."""
    conv_field = parts.schema["conv_id"].dataType
    names = ["conv_id", *STATS, "gaps", "cost", "audit"]
    schema = f"conv_id {conv_field.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", audit string"

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: Any = ()
        stats: list[int] = []
        vector: list = []
        lowest, last_turn, last_role = None, None, ""
        rows: list[list] = []

        def close() -> None:
            cost, audit = result_of(vector)
            gaps = 0 if lowest is None else last_turn - lowest + 1 - stats[5]
            rows.append([here[0], *stats, gaps, cost, flat(audit)])

        def out() -> pa.RecordBatch:
            types = [to_arrow_type(conv_field)] + [pa.int64()] * (len(names) - 2) + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for part in batch.to_pylist():
                matrix = [[None if c is None else (c, a) for c, a in zip(part["costs"][i : i + 4], part["audits"][i : i + 4], strict=True)] for i in (0, 4, 8, 12)]
                own = [part[n] for n in STATS]
                if (part["conv_id"],) != here:
                    if here:
                        close()
                    here, stats, lowest, last_turn = (part["conv_id"],), own, None, None
                    vector = vector_times([(0, ""), None, None, None], matrix)
                else:
                    stats = [a + b for a, b in zip(stats, own, strict=True)]
                    stats[4] += last_role + part["first_role"] not in PAIRS
                    stats[5] -= last_turn is not None and part["lowest"] == last_turn
                    vector = vector_times(vector, matrix)
                last_turn, last_role = part["last_turn"], part["last_role"]
                lowest = part["lowest"] if lowest is None else lowest  # rows without a turn come first
                if len(rows) >= 1000:
                    yield out()
                    rows.clear()
        if here:
            close()
        if rows:
            yield out()

    dealt = parts.repartition(ranges, "conv_id").sortWithinPartitions(*KEYS)
    return dealt.mapInArrow(chain, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> a row per conversation, damaged and repaired:

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows.
    """
    return repair_damaged(damage(conversations))


def repair_damaged(damaged: DataFrame) -> DataFrame:
    """As `repair`, for rows(conv_id, turn, role, text, copies) without nulls in role and text."""
    return _repaired(damaged, False)


def repaired_texts(damaged: DataFrame) -> DataFrame:
    """conv_id, position, role, text: the repaired conversations themselves."""
    return _repaired(damaged, True)


def _repaired(damaged: DataFrame, texts: bool) -> DataFrame:
    rows = damaged.withColumn("digest", F.sha2("text", 256))
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
    small = rows.select(
        *KEYS, "copies", (~F.col("text").rlike(WORD)).alias("blank"), (~last.isin(*ENDS)).alias("cut")
    )
    parts = segments(materialize(faults(small), "repair-faults"))
    ranges = max(2, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plans = combine(materialize(parts, "repair-segments"), ranges)
    return _apply(rows, materialize(plans, "repair-plans"), ranges, texts)


def _apply(rows: DataFrame, plans: DataFrame, ranges: int, texts: bool) -> DataFrame:
    """Carry out the audits over the rows in their order, a conversation after the other, as a stream."""
    conv_field = rows.schema["conv_id"].dataType
    conv_type = conv_field.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    given = [*counts, "rows", "audit"]
    both = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", "copies").unionByName(
        plans.select("conv_id", F.lit(0).alias("kind"), *given), allowMissingColumns=True
    )
    # The plan of a conversation comes before its rows.
    dealt = both.repartition(ranges, "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    if texts:
        names, schema = ["conv_id", "position", "role", "text"], f"conv_id {conv_type}, position long, role string, text string"
        types = [to_arrow_type(conv_field), pa.int64(), pa.string(), pa.string()]
    else:
        names = ["conv_id", *counts, "audit", "repaired_sha256", "n_rows"]
        schema = f"conv_id {conv_type}, " + ", ".join(f"{n} long" for n in counts) + ", audit string, repaired_sha256 string, n_rows long"
        types = [to_arrow_type(conv_field)] + [pa.int64()] * len(counts) + [pa.string(), pa.string(), pa.int64()]
    role_of = {1: "user", 2: "assistant"}

    def carry_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        held = 0
        here: Any = ()
        plan, audit, at, state, position, hashed = [0] * len(counts) + [0], "", 0, START, 0, sha256()

        def put(role: str, text: str, letter: int) -> None:
            nonlocal state, position, held
            if texts:
                out.append([here[0], position, role, text])
                held += len(text)
            else:
                hashed.update((f"\n{role}:{text}" if position else f"{role}:{text}").encode())
            position += 1
            state = NEXT[state, letter]

        def insert() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                new = 2 if state == USER else 1
                put(role_of[new], "", new)
                at += 1

        def close() -> None:
            insert()
            if not texts:
                out.append([here[0], *plan[:-1], audit, hashed.hexdigest(), plan[-1]])

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        columns = ["conv_id", "kind", *given, "role", "text", "copies"]
        for batch in batches:
            for conv, kind, *own, role, text, copies in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if (conv,) != here:
                    if here:
                        close()
                    here = (conv,)
                    plan, audit, at, state, position, hashed = [0] * (len(counts) + 1), "", 0, START, 0, sha256()
                if not kind:
                    *plan, audit = own
                    continue
                for _ in range(copies):
                    insert()
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        put(role, text, ROLES.index(role[0]))
                    elif edit == "R":
                        new = 2 if state == USER else 1
                        put(role_of[new], text, new)
                if len(out) >= 1000 or held > 4_000_000:
                    yield batch_of()
                    out.clear()
                    held = 0
        if here:
            close()
        if out:
            yield batch_of()

    return dealt.mapInArrow(carry_out, schema)
