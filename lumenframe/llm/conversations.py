"""Repair of conversation structure.

A conversation is sound if its roles read ``system? (user assistant)+``. Rows
may be kept, given another role, deleted or preceded by inserted rows, at a cost;
the cheapest edits are found, of ties the audit that is least in ASCII.

Signatures. A row is one character: its role and its fault. A conversation is
cut into pieces of at most ``PIECE`` rows, a piece's characters are its
signature, and each distinct signature is solved once, by memoised recursion,
for every state a conversation can enter and leave it in. Audits are joined
back (common signatures dealt over many tasks) and edits replayed on the rows.

Long conversations. Solutions of pieces compose: costs add, and as no solution's
audit begins with another's (each ends with the edit of its piece's last row),
ties are settled by a rank within the piece. So pieces fold in a tree, ``FAN`` at
a time, and the choice of states goes down the same tree: no task holds more than
``FAN`` solutions or ``PIECE`` rows, however long a conversation is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import drop_table, join_hubs, stage_table
from lumenframe.llm.resample import CRC_TABLE_SQL, crc_sql
from lumenframe.operators.hashing import streamed_sha256
from lumenframe.operators.ordering import placed, same_keys

PIECE, FAN = 256, 256
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system row, after a user row, after an assistant row. What a role leads to, and what an inserted row leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What must follow the last row, by state: edits and their cost.
ENDS, END_COSTS = ("", "ua", "a", ""), (0, 2 * INSERT, INSERT, 0)
#: A row's character by fault: none, truncated, to be deleted; in each the roles s, u, a and any other.
FINE, CUT_OFF, DEAD = "suao", "SUAO", "0123"
WAYS = "array<struct<f:int,t:int,cost:bigint,rank:int,edits:string>>"
AUDIT_FROM, AUDIT_TO = "uaUA ", "IIRR"


def solve(signature: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest edits of a piece by (state before, state after): cost, and an edit word a row, separated by spaces.

    An edit word is the rows inserted before (u, a) and then K, D, or U or A for
    a new role. Memoised recursion over (row, state).
    """

    def moves(c: str, s: int) -> Iterator[tuple[int, str, int]]:
        yield DELETE, "D", s
        if c not in DEAD:
            late = TRUNCATED * (c in CUT_OFF)
            if (s, c.lower()) in KEEPS:
                yield late, "K", KEEPS[s, c.lower()]
            yield REROLE + late, "UA"[NEXT[s] == ASSISTANT], NEXT[s]

    def one(c: str, s: int) -> list[tuple[int, str, int]]:
        """A row's edits from a state, with up to two insertions before: more lead nowhere new."""
        out, before, cost = [], "", 0
        for _ in range(3):
            out += [(cost + k, before + e, t) for k, e, t in moves(c, s)]
            s = NEXT[s]
            before, cost = before + "ua"[s == ASSISTANT], cost + INSERT
        return out

    @lru_cache(maxsize=None)
    def best(i: int, s: int) -> dict[int, tuple[int, str, tuple]]:
        if i == len(signature):
            return {s: (0, "", ())}
        found: dict[int, tuple[int, str, tuple]] = {}
        for cost, edit, t in one(signature[i], s):
            for end, (c, audit, edits) in best(i + 1, t).items():
                way = (cost + c, edit.translate(TO_AUDIT) + audit, (edit, *edits))
                if end not in found or way[:2] < found[end][:2]:
                    found[end] = way
        return found

    return {(s, t): (c, " ".join(edits)) for s in range(4) for t, (c, _, edits) in best(0, s).items()}


TO_AUDIT = {ord(a): b for a, b in zip(AUDIT_FROM, AUDIT_TO)} | {ord(" "): None}


def ranked(ways: dict[tuple[int, int], tuple[int, str]]) -> list[dict]:
    """Ways with the rank of their audit among those from the same state."""
    audits = {k: e.translate(TO_AUDIT) for k, (_, e) in ways.items()}
    order = {s: sorted(a for (f, _), a in audits.items() if f == s) for s in range(4)}
    return [{"f": f, "t": t, "cost": c, "rank": order[f].index(audits[f, t]), "edits": e} for (f, t), (c, e) in ways.items()]


def illegal_pairs(signature: str) -> int:
    """Adjacent roles that are none of system-user, user-assistant, assistant-user."""
    roles = signature.translate({ord(c): FINE[i % 4] for i, c in enumerate(CUT_OFF + DEAD)})
    return sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))


def composed(first: dict, then: dict) -> dict:
    """Ways through two neighbours, each {(f, t): (cost, rank)}."""
    out = {}
    for s in range(4):
        found = {}
        for x in range(4):
            if (s, x) not in first:
                continue
            for t in range(4):
                if (x, t) in then:
                    way = (first[s, x][0] + then[x, t][0], first[s, x][1], then[x, t][1])
                    if t not in found or way < found[t]:
                        found[t] = way
        order = sorted(w[1:] for w in found.values())
        out |= {(s, t): (w[0], order.index(w[1:])) for t, w in found.items()}
    return out


def as_ways(ways) -> dict:
    return {(w["f"], w["t"]): (w["cost"], w["rank"]) for w in ways}


def folded(ways: DataFrame, fan: int) -> DataFrame:
    """(conv, at, ways) -> one row per ``fan`` neighbours."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = None
        for w in rows.sort_values("at")["ways"]:
            out = as_ways(w) if out is None else composed(out, as_ways(w))
        return pd.DataFrame({"conv": [key[0]], "at": [key[1]], "ways": [[{"f": f, "t": t, "cost": c, "rank": r} for (f, t), (c, r) in out.items()]]})

    up = ways.withColumn("up", F.expr(f"at div {fan}"))
    return up.groupBy("conv", "up").applyInPandas(run, ways.schema)


def chosen(parents: DataFrame, ways: DataFrame, fan: int) -> DataFrame:
    """(conv, at, f, t) of a level from the states chosen at the level above."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        own, s, end, out = [as_ways(w) for w in rows["ways"]], int(rows["f"].iloc[0]), int(rows["t"].iloc[0]), []
        rest = [None] * len(own)  # ways from behind each row to the end
        for i in range(len(own) - 2, -1, -1):
            rest[i] = own[i + 1] if rest[i + 1] is None else composed(own[i + 1], rest[i + 1])
        for at, way, after in zip(rows["at"], own, rest):
            if after is None:
                t = end
            else:
                t = min((way[s, x][0] + after[x, end][0], way[s, x][1], x) for x in range(4) if (s, x) in way and (x, end) in after)[2]
            out.append((key[0], at, s, t))
            s = t
        return pd.DataFrame(out, columns=["conv", "at", "f", "t"])

    up = ways.withColumn("up", F.expr(f"at div {fan}")).alias("l").join(parents.alias("r"), F.col("l.conv").eqNullSafe(F.col("r.conv")) & (F.col("l.up") == F.col("r.at")))
    return up.select("l.conv", "l.at", "l.up", "l.ways", "r.f", "r.t").groupBy("conv", "up").applyInPandas(run, "conv string, at bigint, f int, t int")


def best_end(ways: Column) -> Column:
    """Of the ways from the start, (cost with what must follow, rank, t) of the cheapest."""
    ends = F.array(*[F.lit(c) for c in END_COSTS])
    return F.array_min(F.transform(F.filter(ways, lambda w: w["f"] == START), lambda w: F.struct((w["cost"] + F.get(ends, w["t"])).alias("cost"), w["rank"].alias("rank"), w["t"].alias("t"))))


def states(pieces: DataFrame, fan: int) -> DataFrame:
    """(conv, at, ways) of conversations of several pieces -> (conv, at, f, t, cost): states at the ends of each piece; cost is the conversation's."""
    levels = [stage_table(pieces.select("conv", "at", F.transform("ways", lambda w: F.struct(*[w[c].alias(c) for c in ("f", "t", "cost", "rank")])).alias("ways")), "ways")]
    while levels[-1].where("at > 0").limit(1).count():
        levels.append(stage_table(folded(levels[-1], fan), "ways"))
    top = levels[-1].select("conv", "at", best_end(F.col("ways")).alias("b"))
    costs = top.select("conv", F.col("b.cost").alias("cost"))
    down = top.select("conv", "at", F.lit(START).alias("f"), F.col("b.t").alias("t"))
    for level in reversed(levels[:-1]):
        down = chosen(down, level, fan)
    out = stage_table(down.alias("l").join(costs.alias("r"), same_keys("l", "r", ["conv"])).select("l.*", "r.cost"), "states")
    for level in levels:
        drop_table(level)
    return out


def replayed(rows: Column, edits: Column) -> Column:
    """Lines ``role:text`` after a piece's edits, in order: array<string>."""
    inserted = lambda e: F.transform(F.filter(F.split(F.substring(e, F.lit(1), F.length(e) - 1), ""), lambda c: c != ""), lambda c: F.when(c == "u", "user:").otherwise("assistant:"))

    def line(row: Column, edit: Column) -> Column:
        last = F.right(edit, F.lit(1))
        role = F.when(last == "U", "user").when(last == "A", "assistant").otherwise(row["role"])
        own = F.when(last != "D", F.array(F.concat(role, F.lit(":"), row["text"]))).otherwise(F.array().cast("array<string>"))
        return F.concat(inserted(edit), own)

    return F.flatten(F.zip_with(rows, F.split(edits, " "), line))


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults put in by the rows' identity: a test bed for ``repair``. Nulls in the identity, roles and texts are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(said(id_col), F.lit(":"), said(turn_col)).cast("binary")), F.lit(20))
    text = F.when(k == 1, "").when(k == 2, F.translate(said(text_col), ".!?", "")).otherwise(said(text_col))
    out = rows.select(
        F.col(id_col).cast("string").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.when(k == 4, "user").otherwise(said(role_col)).alias("role"),
        text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("times"),
    )
    return out.select("conv", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def repair(rows: DataFrame, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """(conv, turn, role, text) -> a row per conversation: faults, the edits' audit and cost, the repaired texts' hash.

    Rows are taken by turn, nulls first; rows of one turn in an order that
    depends on their values alone. Null roles and texts are one space. Null
    conversations are one conversation. Roles other than system, user and
    assistant (by initial) cannot be kept. An empty table gives no rows.
    """
    texts = rows.select("conv", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    placed_rows = placed(texts, ["conv"], ["turn"])
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = placed_rows.where(~blank).groupBy("conv", said.alias("said")).agg(F.min("place").alias("place")).select("conv", "place", F.lit(True).alias("new"))
    both = placed_rows.alias("l").join(firsts.alias("r"), same_keys("l", "r", ["conv", "place"]), "left")
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    fault = F.when(blank, "blank").when(F.col("new").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    role = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.left("role", F.lit(1))), F.when(F.col("role") == "", F.lit(1)).otherwise(F.lit(0))), F.lit(4))
    alphabet = F.when(F.col("fault").isin("blank", "duplicate"), DEAD).when(F.col("fault") == "truncated", CUT_OFF).otherwise(FINE)
    marked = both.select("l.*", fault.alias("fault")).withColumn("code", F.substring(alphabet, role, F.lit(1)))
    count = lambda f: F.count_if(F.col("fault") == f).alias(f)
    line = F.struct("place", "code", "role", "text")
    grouped = marked.groupBy("conv", F.expr(f"(place - 1) div {piece}").alias("at")).agg(
        F.array_sort(F.collect_list(line)).alias("rows"), count("blank"), count("duplicate"), count("truncated")
    )
    pieces = stage_table(grouped.withColumn("sig", F.array_join(F.transform("rows", lambda r: r["code"]), "")).withColumn("row", F.xxhash64("conv", "at")), "pieces")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(ways=[ranked(solve(s)) for s in b["sig"]], illegal=[illegal_pairs(s) for s in b["sig"]])

    solved = stage_table(pieces.groupBy("sig").agg(F.count("*").alias("n")).mapInPandas(run, f"sig string, n bigint, ways {WAYS}, illegal bigint"), "solved")
    known = stage_table(join_hubs(pieces, solved, "sig", "n", "row").drop("n", "row"), "known")
    # conversations of one piece are settled here; of several, where the pieces' states have been chosen in the tree
    long = stage_table(known.where("at > 0").select("conv").distinct(), "long")
    many = known.alias("l").join(long.alias("r"), same_keys("l", "r", ["conv"]), "left_semi")
    few = known.alias("l").join(long.alias("r"), same_keys("l", "r", ["conv"]), "left_anti")
    ended = few.withColumn("b", best_end(F.col("ways"))).select("*", F.lit(START).alias("f"), F.col("b.t").alias("t"), F.col("b.cost").alias("cost"), F.lit(True).alias("last")).drop("b")
    tops = long.alias("l").join(known.groupBy("conv").agg(F.max("at").alias("top")).alias("r"), same_keys("l", "r", ["conv"])).select("l.conv", "r.top")
    out = ended
    if not long.isEmpty():
        way = states(many, fan).alias("s")
        at = many.alias("l").join(way, same_keys("l", "s", ["conv", "at"])).join(F.broadcast(tops).alias("t") if long.count() < 100_000 else tops.alias("t"), F.col("l.conv").eqNullSafe(F.col("t.conv")))
        out = ended.unionByName(at.select("l.*", "s.f", "s.t", "s.cost", (F.col("l.at") == F.col("t.top")).alias("last")))
    tail = F.when(F.col("last"), F.get(F.array(*[F.lit(e) for e in ENDS]), F.col("t"))).otherwise("")
    edits = F.filter("ways", lambda w: (w["f"] == F.col("f")) & (w["t"] == F.col("t")))[0]["edits"]
    extra = F.transform(F.filter(F.split(tail, ""), lambda c: c != ""), lambda c: F.when(c == "u", "user:").otherwise("assistant:"))
    lines = F.concat(replayed(F.col("rows"), edits), extra)
    done = stage_table(
        out.select(
            "conv", "at", "cost", "blank", "duplicate", "truncated", "illegal", F.left("sig", F.lit(1)).alias("head"), F.right("sig", F.lit(1)).alias("foot"),
            F.translate(F.concat(edits, tail), AUDIT_FROM, AUDIT_TO).alias("audit"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("said"),
        ), "repaired",
    )
    # pairs across the border of two pieces
    near = done.select("conv", (F.col("at") + 1).alias("at"), "foot")
    roles = lambda c: F.translate(c, CUT_OFF + DEAD, FINE * 2)
    pair = F.concat(roles("r.foot"), roles("l.head"))
    cross = done.where("at > 0").alias("l").join(near.alias("r"), same_keys("l", "r", ["conv", "at"])).where(~pair.isin("su", "ua", "au")).groupBy("l.conv").agg(F.count("*").alias("crossed"))
    facts = done.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.max("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "").alias("audit"),
        F.max(F.when(F.col("at") > 0, True)).alias("long"), F.sha2(F.coalesce(F.max(F.when(F.col("at") == 0, F.col("said"))), F.lit("")), 256).alias("hash"),
    )
    gaps = placed_rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    hashes = streamed_sha256(done.alias("l").join(long.alias("r"), same_keys("l", "r", ["conv"]), "left_semi"), ["conv"], ["at"], "said", "streamed")
    joined = facts.alias("l")
    for side, name in ((gaps, "g"), (cross, "c"), (hashes, "h")):
        joined = joined.join(side.alias(name), F.col("l.conv").eqNullSafe(F.col(f"{name}.conv")), "left")
    for old in (pieces, solved, known):
        drop_table(old)
    return joined.select(
        "l.conv", "g.gaps", "l.blank", "l.duplicate", "l.truncated", (F.col("l.illegal") + F.coalesce("c.crossed", F.lit(0))).alias("illegal"), "l.cost", "l.audit",
        F.when(F.col("l.long"), F.col("h.streamed")).otherwise(F.col("l.hash")).alias("repaired_sha256"),
    )


def op12_conversation_repair(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return with_all(given, repair(damaged(given)))


def with_all(given: DataFrame, repaired: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """A row for every conversation of ``given``; one without rows after the damage has zeros, an empty audit and the hash of the empty text."""
    ids = given.select(F.col(id_col)).distinct().withColumn("conv", F.col(id_col).cast("string"))
    numbers = [F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    both = ids.alias("l").join(repaired.alias("r"), same_keys("l", "r", ["conv"]), "left")
    return both.select(f"l.{id_col}", *numbers, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("r.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same by a table of states and a recursive query over the rows.
OP12_SQL = f"""WITH RECURSIVE {CRC_TABLE_SQL},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
drawn AS (SELECT given.*, {crc_sql("key")} % 20 AS k FROM given, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows_),
before_row(s, ins, p, c, said) AS (VALUES
  ('N', '', 'N', 0, []::VARCHAR[]), ('N', 'I', 'U', 2, ['user:']), ('N', 'II', 'A', 4, ['user:', 'assistant:']), ('S', '', 'S', 0, []), ('S', 'I', 'U', 2, ['user:']),
  ('S', 'II', 'A', 4, ['user:', 'assistant:']), ('U', '', 'U', 0, []), ('U', 'I', 'A', 2, ['assistant:']), ('A', '', 'A', 0, []), ('A', 'I', 'U', 2, ['user:'])),
edit(op, p, initial, t, c) AS (VALUES
  ('K', 'N', 's', 'S', 0), ('K', 'N', 'u', 'U', 0), ('K', 'S', 'u', 'U', 0), ('K', 'U', 'a', 'A', 0), ('K', 'A', 'u', 'U', 0),
  ('R', 'N', NULL, 'U', 2), ('R', 'S', NULL, 'U', 2), ('R', 'U', NULL, 'A', 2), ('R', 'A', NULL, 'U', 2),
  ('D', 'N', NULL, 'N', 3), ('D', 'S', NULL, 'S', 3), ('D', 'U', NULL, 'U', 3), ('D', 'A', NULL, 'A', 3)),
tail(s, ins, c, said) AS (VALUES ('N', '', 0, []::VARCHAR[]), ('S', 'II', 4, ['user:', 'assistant:']), ('U', 'I', 2, ['assistant:']), ('A', '', 0, [])),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 'N' AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM (SELECT DISTINCT conv_id FROM rows_)
  UNION ALL
  SELECT conv_id, i, t, cost, audit, said FROM (
    SELECT b.conv_id, r.i, e.t, b.cost + w.c + e.c + CASE WHEN e.op <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost, b.audit || w.ins || e.op AS audit,
      list_concat(list_concat(b.said, w.said), CASE e.op WHEN 'K' THEN [r.role || ':' || r.text] WHEN 'R' THEN [CASE e.t WHEN 'U' THEN 'user:' ELSE 'assistant:' END || r.text] ELSE [] END) AS said
    FROM best b JOIN faults r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1 JOIN before_row w ON w.s = b.s JOIN edit e ON e.p = w.p
    WHERE e.op = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e.op = 'R' OR left(r.role, 1) = e.initial))
  QUALIFY row_number() OVER (PARTITION BY conv_id, t ORDER BY cost, audit) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY conv_id),
ended AS (
  SELECT b.conv_id, b.cost + e.c AS cost, b.audit || e.ins AS audit, array_to_string(list_concat(b.said, e.said), chr(10)) AS said
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i JOIN tail e ON e.s = b.s
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + e.c, b.audit || e.ins) = 1)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id"""
