"""Conversation repair: the cheapest edits that make roles alternate, by a rank-compressed dynamic programme.

Rows of a conversation are its layers. A macro edit is a run of insertions and
what becomes of the next row: their initials, such as `IK`, are prefix-free, so
audits of as many macros compare as their first different macros do. A state
therefore keeps no audit but its cost and its rank among the layer's states; the
next layer's order follows from rank and macro. Parent pointers give the audit
in the end.

Conversations are sorted over all tasks and cut into chunks of bounded size. Most lie
whole in one chunk and are repaired where they stand. For all others each chunk
says, for each state to begin in, what it costs to reach each state and how
those paths rank; these summaries are chained per conversation, and each
chunk is gone through again between the two states that the chain chose.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import materialize

#: What the repaired initials read so far: nothing, s, or an end on u or a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or re-roled row leads from each of them.
NEXT = (USER, USER, ASSISTANT, USER)
#: Insertions that end a conversation well.
TAIL = ("", "II", "I", "")
#: Costs by contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Macro edits in ASCII order. Three insertions in a row lead where one does.
MACROS = tuple(sorted(run + edit for run in ("", "I", "II") for edit in "DKR"))
#: Faults of a row; the last two must be deleted.
FINE, CUT_OFF, BLANK, DUPLICATE = range(4)
#: A chunk holds so many rows and bytes of text at most; a longer text is a chunk alone.
CHUNK_ROWS, CHUNK_BYTES = 1024, 1 << 20

_INITIALS = {"s": 0, "u": 1, "a": 2}


def _moves(kind: int) -> tuple:
    """For each state, (to, cost, macro) of the best macro to each state it can reach with a row of the kind: 4 * fault + initial."""
    fault, initial = divmod(kind, 4)
    out = []
    for begin in range(4):
        best: dict[int, tuple[int, int]] = {}
        for macro, said in enumerate(MACROS):
            state, cost = begin, INSERT * (len(said) - 1)
            for _ in said[:-1]:
                state = NEXT[state]
            edit = said[-1]
            if edit == "D":
                cost += DELETE
            elif fault in (BLANK, DUPLICATE):
                continue
            else:
                cost += TRUNCATED * (fault == CUT_OFF)
                if edit == "R":
                    state, cost = NEXT[state], cost + REROLE
                elif initial == 0 and state == EMPTY:
                    state = SYSTEM
                elif initial in (1, 2) and NEXT[state] == (USER, ASSISTANT)[initial - 1]:
                    state = NEXT[state]
                else:
                    continue
            best[state] = min(best.get(state, (cost, macro)), (cost, macro))
        out.append(tuple((to, cost, macro) for to, (cost, macro) in best.items()))
    return tuple(out)


#: Of each kind of row.
MOVES = tuple(_moves(kind) for kind in range(16))


def _layers(kinds: bytes, begin: int, keep: bool):
    """(costs, ranks, pointers) after all rows: costs None where a state is out of reach, pointers (from, macro) of each layer and state if kept."""
    costs: list[int | None] = [None] * 4
    costs[begin], ranks, pointers = 0, [0] * 4, []
    for kind in kinds:
        best: list[tuple[int, int, int, int] | None] = [None] * 4
        for state, moves in enumerate(MOVES[kind]):
            if (had := costs[state]) is not None:
                rank = ranks[state]
                for to, cost, macro in moves:
                    came = (had + cost, rank, macro, state)
                    if best[to] is None or came < best[to]:
                        best[to] = came
        order = sorted((b[1], b[2], to) for to, b in enumerate(best) if b)
        for place, (_, _, to) in enumerate(order):
            ranks[to] = place
        costs = [b and b[0] for b in best]
        if keep:
            pointers.append([b and (b[3], b[2]) for b in best])
    return costs, ranks, pointers


def _finish(costs, ranks) -> tuple[int, int]:
    """(cost, state) of the best end."""
    cost, _, state = min((c + INSERT * len(TAIL[s]), ranks[s], s) for s, c in enumerate(costs) if c is not None)
    return cost, state


def _macros(pointers, end: int) -> list[str]:
    out = []
    for layer in reversed(pointers):
        end, macro = layer[end]
        out.append(MACROS[macro])
    return out[::-1]


def _apply(roles, texts, macros, begin: int, end: int, last: bool):
    """(edit, role, text) of each repaired row, and the audit."""
    state, out = begin, []
    named = ("user", "user", "assistant", "user")  # the role that comes after each state
    for role, text, said in zip(roles, texts, macros, strict=True):
        for _ in said[:-1]:
            out.append(("I", named[state], ""))
            state = NEXT[state]
        if said[-1] == "K":
            out.append(("K", role, text))
            state = SYSTEM if role[:1] == "s" else NEXT[state]
        elif said[-1] == "R":
            out.append(("R", named[state], text))
            state = NEXT[state]
    tail = TAIL[end] if last else ""
    for _ in tail:
        out.append(("I", named[state], ""))
        state = NEXT[state]
    return out, "".join(macros) + tail


def repaired(roles: list[str], texts: list[str], faults: list[int]):
    """(cost, audit, rows) of one conversation that is at hand as a whole."""
    kinds = _kinds(roles, faults)
    costs, ranks, pointers = _layers(kinds, EMPTY, True)
    cost, end = _finish(costs, ranks)
    rows, audit = _apply(roles, texts, _macros(pointers, end), EMPTY, end, True)
    return cost, audit, rows


def _kinds(roles, faults) -> bytes:
    return bytes(4 * f + _INITIALS.get(r[:1], 3) for r, f in zip(roles, faults, strict=True))


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


# ---- From rows to chunks ----


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone: the rows as the contract damages them, nulls as one space (turn itself stays null).

    Dropped rows stay as gone, so that their conversation is reported.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), what.alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("what") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("what") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def fault_of(text: Column) -> Column:
    """BLANK without a character other than white space, CUT_OFF where the last such character is not of `.!?`, else FINE."""
    said = F.rtrim(text, F.lit(" \t\n\v\f\r"))
    return F.when(said == "", BLANK).when(~F.substring(said, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(FINE).cast("tinyint")


_CHUNK = "turns array<bigint>, roles array<string>, texts array<string>, marks array<binary>, faults array<tinyint>"


def _packer(schema: pa.Schema, most_rows: int, most_bytes: int):
    """Sorted rows (conv_id, gone, turn, role, text, mark, fault) to chunks, one conversation's rows in each."""

    def run(batches):
        none = object()
        now, first, begun, size = none, True, True, 0
        rows: list[tuple] = []
        out: list[tuple] = []
        held = 0

        def flush(alone: bool):
            nonlocal rows, size, held
            out.append((now, alone, *(list(x) for x in (zip(*rows, strict=True) if rows else [()] * 5))))
            held += size
            rows, size = [], 0

        def made():
            nonlocal out, held
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(schema)], schema=schema)
            out, held = [], 0
            return batch

        for batch in batches:
            ids, gone, *rest = (batch.column(i).to_pylist() for i in range(batch.num_columns))
            for own, out_of, row in zip(ids, gone, zip(*rest, strict=True), strict=True):
                if now is none or own != now:
                    if now is not none:
                        flush(begun and not first)
                        first = False
                    now, begun = own, True
                if out_of:
                    continue
                length = len(row[2])
                if rows and (len(rows) >= most_rows or size + length > most_bytes):
                    flush(False)
                    begun = False
                rows.append(row)
                size += length
                if held > most_bytes or len(out) >= most_rows:
                    yield made()
        if now is not none:
            flush(False)  # the next task may go on with it
        if out:
            yield made()

    return run


# ---- Chains of chunks ----

_FACTS = "kinds binary, low bigint, high bigint, turns bigint, first_turn bigint, last_turn bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string, costs array<bigint>, ranks array<int>"


def _facts(turns, roles, faults) -> tuple:
    """A chunk's counts, in the order of _FACTS from low on up to last_role."""
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    count = lambda k: sum(f == k for f in faults)
    return (known[0] if known else None, known[-1] if known else None, len(set(known)), turns[0] if turns else None, turns[-1] if turns else None, count(BLANK), count(DUPLICATE), count(CUT_OFF), _illegal(initials), initials[0] if initials else None, initials[-1] if initials else None)


def _marked(faults, marks, new) -> list[int]:
    """Faults with repeated rows as DUPLICATE: those not among the places that are new, or, if new is None, seen earlier here."""
    if new is not None:
        fresh = set(new)
        return [f if f == BLANK or i in fresh else DUPLICATE for i, f in enumerate(faults)]
    seen, out = set(), []
    for f, m in zip(faults, marks, strict=True):
        out.append(DUPLICATE if m in seen and f != BLANK else f)
        seen.add(m)
    return out


def _summarise(schema: pa.Schema):
    """Chunks (conv_id, chunk, turns, roles, faults, new) to their facts."""

    def run(batches):
        for batch in batches:
            out = []
            for conv, chunk, turns, roles, faults, new in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                faults = _marked(faults, (), new or [])
                kinds, costs, ranks = _kinds(roles, faults), [], []
                for begin in range(4):
                    c, r, _ = _layers(kinds, begin, False)
                    costs += c
                    ranks += r
                out.append((conv, chunk, kinds, *_facts(turns, roles, faults), costs, ranks))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(schema)], schema=schema)

    return run


_TOTALS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _route(schema: pa.Schema):
    """Facts, sorted by conversation and chunk, to (chunk, begin, end, last, and on the last one the totals)."""

    def chain(own):
        """The states before and after each chunk; a few numbers a chunk are held."""
        costs, ranks, back = [0, None, None, None], [0] * 4, []
        low = high = last_turn = last_role = None
        distinct = 0
        sums = [0, 0, 0, 0]
        chunks = []
        for f in own:
            chunks.append(f["chunk"])
            best = [None] * 4
            for to in range(4):
                best[to] = min(((c + f["costs"][4 * s + to], ranks[s], s) for s, c in enumerate(costs) if c is not None and f["costs"][4 * s + to] is not None), default=None)
            order = sorted((b[1], f["ranks"][4 * b[2] + to], to) for to, b in enumerate(best) if b)
            ranks = [0] * 4
            for place, (_, _, to) in enumerate(order):
                ranks[to] = place
            costs = [b and b[0] for b in best]
            back.append([b and b[2] for b in best])
            sums = [a + f[k] for a, k in zip(sums, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
            if f["first_role"] is not None:
                if last_role is not None:
                    sums[3] += _illegal([last_role, f["first_role"]])
                last_role = f["last_role"]
            if f["low"] is not None:
                distinct += f["turns"] - (last_turn == f["low"])
                low = f["low"] if low is None else low
                high = last_turn = f["high"]
        cost, end = _finish(costs, ranks)
        gaps = 0 if low is None else min(high - low + 1 - distinct, 2**63 - 1)
        out = []
        for i in range(len(chunks) - 1, -1, -1):
            begin = back[i][end]
            totals = (gaps, *sums, cost) if i == len(chunks) - 1 else (None,) * 6
            out.append((chunks[i], begin, end, i == len(chunks) - 1, *totals))
            end = begin
        return out

    def run(batches):
        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)

        now, own = None, []
        for batch in batches:
            for f in batch.to_pylist():
                if own and f["conv_id"] != now:
                    yield table(chain(own))
                    own = []
                now = f["conv_id"]
                own.append({k: v for k, v in f.items() if k not in ("conv_id", "kinds")})
        if own:
            yield table(chain(own))

    return run


# ---- Reports and repaired rows ----

_REPORT = f"{_TOTALS}, audit string, repaired_sha256 string"
_TURN = "chunk bigint, place int, edit string, role string, text string"


def _whole(batch):
    """Chunks that are whole conversations: (conv_id, chunk, facts, cost, audit, rows)."""
    for conv, chunk, turns, roles, texts, marks, faults in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
        faults = _marked(faults, marks, None)
        low, high, distinct, _, _, blank, duplicate, truncated, illegal, *_ = _facts(turns, roles, faults)
        cost, audit, rows = repaired(roles, texts, faults)
        gaps = 0 if low is None else min(high - low + 1 - distinct, 2**63 - 1)
        yield conv, chunk, True, (gaps, blank, duplicate, truncated, illegal, cost), audit, rows


def _parts(batch):
    """Chunks between the states that their chain chose; totals come with the last one."""
    for conv, chunk, roles, texts, kinds, begin, end, last, *totals in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
        _, _, pointers = _layers(kinds, begin, True)
        rows, audit = _apply(roles, texts, _macros(pointers, end), begin, end, last)
        yield conv, chunk, last, tuple(totals), audit, rows


def _report(read, schema: pa.Schema):
    """Chunks of a conversation, one after another, to its report: the digest is carried on from chunk to chunk."""

    def run(batches):
        digest, audits, begun = hashlib.sha256(), [], False
        for batch in batches:
            out = []
            for conv, _, last, totals, audit, rows in read(batch):
                audits.append(audit)
                for _, role, text in rows:
                    digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
                if last:
                    out.append((conv, *totals, "".join(audits), digest.hexdigest()))
                    digest, audits, begun = hashlib.sha256(), [], False
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _turns(read, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            out = [(conv, chunk, i, *row) for conv, chunk, _, _, _, rows in read(batch) for i, row in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(schema)], schema=schema)

    return run


class Repair:
    """What repair() found: reports() has a row for each conversation, turns() the repaired rows."""

    def __init__(self, id_type: str, alone: DataFrame, parts: DataFrame):
        self._id, self._alone, self._parts = f"conv_id {id_type}", alone, parts

    def _both(self, make, schema: str) -> DataFrame:
        spark, schema = self._alone.sparkSession, f"{self._id}, {schema}"
        arrow = _arrow(spark, schema)
        return self._alone.mapInArrow(make(_whole, arrow), schema).unionByName(self._parts.mapInArrow(make(_parts, arrow), schema))

    def reports(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A conversation's digest is one chain of hashes: its chunks pass through one task one by one, its text never at once."""
        return self._both(_report, _REPORT)

    def turns(self) -> DataFrame:
        """conv_id, chunk, place, edit (I, K or R), role, text: the repaired rows, in the order of chunk and place."""
        return self._both(_turns, _TURN)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def repair(rows: DataFrame, *, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> Repair:
    """The cheapest repair of every conversation: rows has conv_id, turn, role, text and gone; other columns are left out.

    Rows stand by turn, nulls first; rows of equal turn by a digest of role and text.
    Null roles and texts count as one space, a null conv_id is a conversation. Rows that are gone
    count for nothing, but a conversation of such rows alone is reported: zeros, an empty audit, the
    digest of nothing. No rows: no reports.
    """
    spark = rows.sparkSession
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select("conv_id", F.col("gone"), F.col("turn").cast("bigint").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    mark = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    # Rows that are alike have a number each, so that any number of them can be parted by ranges.
    own = materialize(own.withColumns({"mark": mark, "fault": fault_of(F.col("text")), "row": F.monotonically_increasing_id()}))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("conv_id", "turn", "mark", "row")
    sorted_rows = own.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "gone", "turn", "role", "text", "mark", "fault")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    packed = f"conv_id {id_type}, alone boolean, {_CHUNK}"
    chunks = materialize(sorted_rows.mapInArrow(_packer(_arrow(spark, packed), chunk_rows, chunk_bytes), packed).withColumn("chunk", F.monotonically_increasing_id()))
    rest = chunks.where("not alone")
    # Where each role and text is first said in conversations of several chunks.
    marks = rest.select("conv_id", "chunk", F.posexplode("marks").alias("pos", "mark"))
    first = marks.groupBy("conv_id", "mark").agg(F.min(F.struct("chunk", "pos")).alias("at"))
    new = materialize(first.groupBy(F.col("at.chunk").alias("chunk")).agg(F.collect_list("at.pos").alias("new")))  # a chunk's rows at most
    light = rest.select("conv_id", "chunk", "turns", "roles", "faults").join(new, "chunk", "left").select("conv_id", "chunk", "turns", "roles", "faults", "new")
    schema = f"conv_id {id_type}, chunk bigint, {_FACTS}"
    facts = materialize(light.mapInArrow(_summarise(_arrow(spark, schema)), schema))
    chained = facts.drop("kinds").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    schema = f"chunk bigint, begin int, end int, last boolean, {_TOTALS}"
    routes = materialize(chained.mapInArrow(_route(_arrow(spark, schema)), schema))
    met = rest.select("conv_id", "chunk", "roles", "texts").join(facts.select("chunk", "kinds"), "chunk").join(routes, "chunk")
    fields = ["conv_id", "chunk", "roles", "texts", "kinds", "begin", "end", "last", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    met = met.select(*fields).repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    alone = chunks.where("alone").select("conv_id", "chunk", "turns", "roles", "texts", "marks", "faults")
    return Repair(id_type, alone, met)
