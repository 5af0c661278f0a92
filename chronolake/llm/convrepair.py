"""Repair of conversation structure by weighted finite-state composition.

A conversation is an input acceptor: a chain with one symbol for each row.  An edit transducer
keeps, renames or deletes rows and inserts new ones; a role-grammar acceptor takes what comes out.
Both are small tables; arcs of their composition are made when a state is first met.  An input
state lies between two rows, and the transducer counts the rows inserted since the last one (two
at most: the grammar has come round to the same state by then, at a cost), so that the composition
has no cycle and its states are in topological order.  Weights are pairs (cost, labels), compared
in that order; one label is put before the best rest of a path, which keeps the order of weights, so
that the shortest path is found from the end of a conversation to its start.

Conversations of any length: rows are sorted into ranges of (conversation, turn, role, text), whose
tasks cut them into chunks.  A conversation that lies inside one chunk is repaired there.  Of the
others each chunk gives its matrix of best weights between grammar states; the labels, a byte for
each row, of one conversation come together, as the audit that is asked for is one string, while texts
stay in their chunks.  No two label strings of one weight between the same grammar states are one the beginning of
the other (what follows would be a cycle of insertions, which costs), so that products of matrices keep
the order too.  Only the hash of a conversation that lies in several chunks reads them one after another.

Defined results: null roles and texts are one space; rows go by turn (nulls first), role and text;
equal rows of one turn are duplicates of the first of them; rows without conversation are one
conversation; a turn that is no number is null; further columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Rows and characters of a chunk, at most (a row at least).
ROWS, CHARS = 1024, 1 << 19
#: Symbol strings whose repairs a task keeps.
KEPT = 100_000
SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of keeping or renaming a row that breaks off.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
BROKEN = 1
#: The grammar (s?(ua)+)?: next state by state and role initial; final states.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
_TURNS = "array<struct<role: string, text: string>>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_STATS = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, n_turns long, first_turn long, last_turn long"
_MATRIX = "array<struct<i: int, j: int, cost: long, label: string>>"
_CHUNK = f"part int, no int, done boolean, cost long, label string, {_STATS}, matrix {_MATRIX}, turns {_TURNS}, symbols string"


def edits(symbol: str):
    """(label, cost, output) of the edit transducer for a row; x is a row that has to go, capitals break off."""
    yield "D", COSTS["D"], None
    if symbol != "x":
        more, role = BROKEN * symbol.isupper(), symbol.lower()
        if role != "o":
            yield "K", COSTS["K"] + more, role
        for out in NAMES:
            yield "R", COSTS["R"] + more, out


class Composition:
    """Arcs of acceptor, transducer and grammar composed; those of a state are made when it is first met."""

    def __init__(self):
        self.arcs: dict[tuple[str, int], list] = {}
        self.inserts: list = [[("I", COSTS["I"], GRAMMAR[g][out]) for out in NAMES if out in GRAMMAR[g]] for g in range(4)]
        self.known: dict[str, tuple[int, str]] = {}

    def rows(self, symbol: str, state: int) -> list:
        """Arcs that take a row: (label, cost, next grammar state)."""
        if (key := (symbol, state)) not in self.arcs:
            self.arcs[key] = [(label, cost, state if out is None else GRAMMAR[state][out]) for label, cost, out in edits(symbol) if out is None or out in GRAMMAR[state]]
        return self.arcs[key]

    def inserted(self, rest: list) -> list:
        """Best weights with up to two rows inserted before what rest has the weights of."""
        now = rest
        for _ in range(2):
            now = [min([w for w in (rest[g], *((now[to][0] + cost, label + now[to][1]) for label, cost, to in self.inserts[g] if now[to])) if w], default=None) for g in range(4)]
        return now

    def before(self, symbols: str, after: list) -> list:
        """Best weight from each grammar state over all rows on to the weights after them."""
        for symbol in reversed(symbols):
            taken = [min(((after[to][0] + cost, label + after[to][1]) for label, cost, to in self.rows(symbol, g) if after[to]), default=None) for g in range(4)]
            after = self.inserted(taken)
        return after

    def ends(self) -> list:
        return self.inserted([(0, "") if g in FINAL else None for g in range(4)])

    def matrix(self, symbols: str) -> list[tuple[int, int, int, str]]:
        """(from, to, cost, labels) of the best paths over a chunk's rows between grammar states."""
        out = []
        for j in range(4):
            after = self.before(symbols, [(0, "") if g == j else None for g in range(4)])
            out += [(i, j, *w) for i, w in enumerate(after) if w]
        return out

    def best(self, symbols: str) -> tuple[int, str]:
        """Cost and labels of the cheapest repair of a whole conversation."""
        if symbols not in self.known:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[symbols] = self.before(symbols, self.ends())[0]
        return self.known[symbols]

    def repaired(self, rows: list[tuple[str, str]], symbols: str, label: str, state: int = 0) -> list[tuple[str, str]]:
        """The turns that the labels make of rows (role, text), from a grammar state on."""
        out, at = [], 0
        for x in label:
            if x == "D":
                at += 1
                continue
            initial = symbols[at].lower() if x == "K" else next(c for c in NAMES if c in GRAMMAR[state])
            out.append(("", "") if x == "I" else rows[at])
            out[-1] = (out[-1][0] if x == "K" else NAMES[initial], out[-1][1])
            at += x != "I"
            state = GRAMMAR[state][initial]
        return out


def _count(rows: list) -> tuple:
    """The values of _STATS for rows (turn, role, text, symbol, fault)."""
    faults = [r[4] for r in rows]
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    changes = sum(a != b for a, b in zip(turns, turns[1:], strict=False)) + bool(turns)
    ends = (turns[0], turns[-1]) if turns else (None, None)
    return (*(faults.count(k) for k in _COUNTS[:3]), illegal, initials[0], initials[-1], *ends, changes, *ends)


def _chunks(schema):
    """Over sorted rows (conv_id, turn, role, text, later): repaired conversations, and chunks of those that go on elsewhere."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, machine = TaskContext.get().partitionId(), Composition()
        fields, out, weight = [f.name for f in schema], [], 0
        kinds = {f.name: f.type for f in schema}

        def batch():
            arrays = [pa.array([r[k] for r in out], kinds[c]) for k, c in enumerate(fields)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=fields)

        conv, rows, no, inside, chars, before = None, [], 0, False, 0, None

        def emit(done: bool):
            symbols, texts = "".join(r[3] for r in rows), [(r[1], r[2]) for r in rows]
            cost, label = machine.best(symbols) if done else (None, None)
            turns = machine.repaired(texts, symbols, label) if done else texts
            matrix = None if done else [dict(zip("ij", m[:2], strict=True)) | {"cost": m[2], "label": m[3]} for m in machine.matrix(symbols)]
            out.append((conv, part, no, done, cost, label, *_count(rows), matrix, [{"role": a, "text": b} for a, b in turns], None if done else symbols))

        # the conversations of a range but its first and last lie in it wholly
        first = True
        for given in batches:
            for row_conv, turn, role, text, later in zip(*(given.column(k).to_pylist() for k in range(5)), strict=True):
                if first or row_conv != conv:
                    if not first:
                        emit(inside)
                        inside, no = True, no + 1
                    conv, rows, chars, first, before = row_conv, [], 0, False, None
                elif len(rows) >= ROWS or (rows and chars + len(text) > CHARS):
                    emit(False)
                    rows, chars, inside, no = [], 0, False, no + 1
                solid = text.rstrip(SPACE)
                again = later or before == (turn, role, text)
                fault = "blank" if not solid else "duplicate" if again else "truncated" if solid[-1] not in ".!?" else None
                role_symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
                symbol = "x" if fault in ("blank", "duplicate") else role_symbol.upper() if fault else role_symbol
                before = (turn, role, text)
                rows.append((turn, role, text, symbol, fault))
                chars, weight = chars + len(text), weight + len(text)
                if weight > CHARS or len(out) >= 4096:
                    yield batch()
                    weight = 0
        if not first:
            emit(False)
        yield batch()

    return run


def _combined(chunks: list[dict]) -> dict:
    """The conversation that chunks, in order, make: its counts, its cheapest repair, and each chunk's part of it."""
    machine = Composition()
    vectors = [machine.ends()]
    for c in reversed(chunks):
        after, now = vectors[-1], [None] * 4
        for m in c["matrix"]:
            if after[m["j"]]:
                w = (m["cost"] + after[m["j"]][0], m["label"] + after[m["j"]][1])
                now[m["i"]] = w if now[m["i"]] is None else min(w, now[m["i"]])
        vectors.append(now)
    vectors.reverse()
    out = {k: sum(c[k] for c in chunks) for k in _COUNTS}
    out["cost"], out["label"] = vectors[0][0]
    state, last, turn, n_turns, parts = 0, None, None, 0, []
    for c, after in zip(chunks, vectors[1:], strict=True):
        if last is not None:
            out["illegal"] += last + c["first"] not in LEGAL
        last = c["last"]
        n_turns += c["n_turns"] - (turn is not None and turn == c["first_turn"])
        turn = c["last_turn"] if c["last_turn"] is not None else turn
        step = min((m["cost"] + after[m["j"]][0], m["label"] + after[m["j"]][1], m["j"], m["label"]) for m in c["matrix"] if m["i"] == state and after[m["j"]])
        parts.append({"part": c["part"], "no": c["no"], "state": state, "label": step[3]})
        state = step[2]
    parts[-1]["label"] += vectors[-1][state][1]
    low, high = ([c[k] for c in chunks if c[k] is not None] for k in ("low", "high"))
    return out | {"low": min(low, default=None), "high": max(high, default=None), "n_turns": n_turns, "parts": parts}


def _join_chunks(schema):
    def run(batches):
        import pyarrow as pa

        for given in batches:
            got = [{"conv_id": c} | _combined(chunks) for c, chunks in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(got, schema)

    return run


def _apply_labels(batches):
    """Repaired turns of chunks (symbols, turns, state, label), the last column."""
    import pyarrow as pa

    machine = Composition()
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for given in batches:
        got = []
        for symbols, turns, state, label in zip(*(given.column(c).to_pylist() for c in ("symbols", "turns", "state", "label")), strict=True):
            made = machine.repaired([(t["role"], t["text"]) for t in turns], symbols, label, state)
            got.append([{"role": a, "text": b} for a, b in made])
        keep = ["conv_id", "part", "no"]
        yield pa.RecordBatch.from_arrays([*(given.column(c) for c in keep), pa.array(got, kind)], names=[*keep, "turns"])


def _hashes(kind):
    """Over chunks sorted by conversation and place: the hash of each conversation's repaired turns."""

    def run(batches):
        import pyarrow as pa

        conv, digest, some = None, None, False
        ids, sums = [], []
        for given in batches:
            for c, turns in zip(given.column("conv_id").to_pylist(), given.column("turns").to_pylist(), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        ids.append(conv)
                        sums.append(digest.hexdigest())
                    conv, digest, some = c, hashlib.sha256(), False
                for t in turns:
                    digest.update(("\n" * some + t["role"] + ":" + t["text"]).encode())
                    some = True
        if digest is not None:
            ids.append(conv)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sums)], names=["conv_id", "repaired_sha256"])

    return run


def _arrow(df_schema: str, spark: SparkSession):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(df_schema))


class Repaired:
    """What the repair of rows (conv_id, turn, role, text) gives.

    conversations: conv_id, blank, duplicate, truncated, illegal, gaps, cost and audit; turns(): the repaired
    turns; hashes(): the SHA-256 of each conversation's turns as role:text, newline-joined.
    """

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        self.id_type = rows.schema["conv_id"].dataType.simpleString()
        rows = rows.select("conv_id", F.col("turn").try_cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
        at, same = F.struct(F.col("turn").isNotNull(), "turn"), [F.col("conv_id"), F.col("role"), F.md5("text").alias("_text")]
        some = rows.where(F.length(F.btrim("text", F.lit(SPACE))) > 0)
        again = some.groupBy(*same).agg(F.count("*").alias("_n"), F.min(at).alias("_first")).where("_n > 1")
        again = again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), "_text", "_first")
        match = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.md5("text") == F.col("_text"))
        flagged = rows.join(again, match, "left").select("conv_id", "turn", "role", "text", F.coalesce(F.col("_first") < at, F.lit(False)).alias("later"))
        # bounds of ranges are sampled, so they get a text's beginning only
        ranged = flagged.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 32))
        ranged = ranged.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
        schema = f"conv_id {self.id_type}, {_CHUNK}"
        chunks, _ = written(ranged.mapInArrow(_chunks(_arrow(schema, spark)), schema), "repair-chunks")
        self.whole, pending = chunks.where("done"), chunks.where("NOT done")
        light = pending.drop("turns", "symbols", "done", "cost", "label")
        each = light.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in light.columns if c != "conv_id"]))).alias("chunks"))
        schema = f"conv_id {self.id_type}, blank long, duplicate long, truncated long, illegal long, cost long, label string, low long, high long, n_turns long, parts array<struct<part: int, no: int, state: int, label: string>>"
        joined, _ = written(each.mapInArrow(_join_chunks(_arrow(schema, spark)), schema), "repair-joined")
        gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
        columns = ["conv_id", gaps, *_COUNTS, "cost", F.col("label").alias("audit")]
        self.conversations = self.whole.select(*columns).unionByName(joined.select(*columns))
        place = joined.select(F.explode("parts").alias("p")).select(F.col("p.part").alias("_part"), F.col("p.no").alias("_no"), "p.state", "p.label")
        parts = pending.drop("label", "cost").join(place, (F.col("part") == F.col("_part")) & (F.col("no") == F.col("_no"))).select("conv_id", "part", "no", "symbols", "turns", "state", "label")
        self.parts = parts.mapInArrow(_apply_labels, f"conv_id {self.id_type}, part int, no int, turns {_TURNS}")

    def turns(self) -> DataFrame:
        """conv_id, part, no, place, role and text: a conversation's repaired turns go by part, no and place."""
        every = self.whole.select("conv_id", "part", "no", "turns").unionByName(self.parts)
        return every.select("conv_id", "part", "no", F.posexplode("turns").alias("place", "_turn")).select("conv_id", "part", "no", "place", "_turn.role", "_turn.text")

    def hashes(self) -> DataFrame:
        here = self.whole.select("conv_id", F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").cast("binary"), 256).alias("repaired_sha256"))
        ordered = self.parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
        kind = _arrow(f"conv_id {self.id_type}", ordered.sparkSession).field(0).type
        return here.unionByName(ordered.mapInArrow(_hashes(kind), f"conv_id {self.id_type}, repaired_sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that the query plants, chosen by crc32 of conv_id:turn."""
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))
    fault, text = F.crc32(key.cast("binary")) % 20, F.coalesce("text", F.lit(" "))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("_fault", fault).where("_fault <> 0")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "_fault")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1)))).drop("_fault", "_copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of all conversations after damage; conversations that lost all rows have zeros."""
    rows = table(spark, sf_dir, "conversations")
    got = Repaired(damaged(rows))
    every = rows.select("conv_id").distinct()
    for part in (got.conversations, got.hashes()):
        part = part.withColumnRenamed("conv_id", "_conv")
        every = every.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: CRC-32 in DuckDB, which has no function of that name: the table, and a fold over a text's bytes.
CRC_TABLE = """crc_steps AS (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v FROM range(256) r(i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps)"""


def crc_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text; crc_table is to be joined."""
    byte = f"list_transform(range(strlen({text})), lambda q: CAST('0x' || substr(hex(encode({text})), 2 * q + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({byte}, lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _least(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda w: w.c < 1000000000))"


def _step(g: int) -> str:
    """Best weight of taking a row in grammar state g."""
    options = [f"{{c: 3 + w{g}.c, l: 'D' || w{g}.l}}"]
    for out, to in GRAMMAR[g].items():
        options.append(f"{{c: CASE WHEN s = '{out}' AND NOT gone THEN t + w{to}.c ELSE 1000000000 END, l: 'K' || w{to}.l}}")
        if out != "s":
            options.append(f"{{c: CASE WHEN NOT gone THEN 2 + t + w{to}.c ELSE 1000000000 END, l: 'R' || w{to}.l}}")
    return f"list_min([{', '.join(options)}])"


def _with_inserts(v: str) -> str:
    paths = {0: ((0, ""), (2, "I"), (3, "II")), 1: ((1, ""), (2, "I"), (3, "II")), 2: ((2, ""), (3, "I")), 3: ((3, ""), (2, "I"))}
    return ", ".join(f"list_min([{', '.join(f'{{c: {v}{to}.c + {2 * len(l)}, l: {chr(39)}{l}{chr(39)} || {v}{to}.l}}' for to, l in paths[g])}]) AS w{g}" for g in range(4))


SQL = {
    "op11_conversation_repair": rf"""
WITH RECURSIVE {CRC_TABLE},
base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT base.*, {crc_sql("k")} % 20 AS f FROM base, crc_table),
made AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM made),
faults AS (SELECT conv_id, turn, role, text, n, left(role, 1) AS s, CASE WHEN solid = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
symbols AS (SELECT conv_id, n, s, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t FROM faults),
counts AS (SELECT conv_id, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || s NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
ends AS (SELECT {{c: 0, l: ''}} AS v0, {{c: 1000000000, l: ''}} AS v1, {{c: 1000000000, l: ''}} AS v2, {{c: 0, l: ''}} AS v3),
paths AS (
  SELECT conv_id, size AS n, {_with_inserts("v")} FROM counts, ends
  UNION ALL
  SELECT conv_id, n - 1, {_with_inserts("v")} FROM (
    SELECT p.conv_id, p.n, {_step(0)} AS v0, {_step(1)} AS v1, {_step(2)} AS v2, {_step(3)} AS v3
    FROM paths p JOIN symbols y ON y.conv_id IS NOT DISTINCT FROM p.conv_id AND y.n = p.n)),
best AS (SELECT conv_id, w0.c AS cost, w0.l AS audit FROM paths WHERE n = 0),
labels AS (SELECT conv_id, p, audit[p] AS x, p - length(replace(audit[:p], 'I', '')) AS added, length(replace(audit[:p - 1], 'D', '')) AS place
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)),
kept AS (SELECT l.conv_id, p, x, place, f.role, f.text, f.s FROM labels l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = p - added AND x <> 'I' WHERE x <> 'D'),
begins AS (SELECT conv_id, max(CASE WHEN place = 0 AND x = 'K' AND s = 's' THEN 1 ELSE 0 END) AS system FROM kept GROUP BY conv_id),
turns AS (SELECT k.conv_id, p, CASE WHEN x = 'K' THEN role WHEN (place - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END AS piece
  FROM kept k JOIN begins b ON b.conv_id IS NOT DISTINCT FROM k.conv_id),
whole AS (SELECT conv_id, sha256(string_agg(piece, chr(10) ORDER BY p)) AS h FROM turns GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM e.conv_id
""",
}
