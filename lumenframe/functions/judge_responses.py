"""Judge responses: JSON of a fixed schema, with evidence kept only if it stands in the judged text. Column expressions over tagged variants.

A response that breaks the protocol is a row with an ``error``, so that one bad
row doesn't stop a scan; ``judging.require`` or a filter decides what follows.
Of several faults the first in the order below is named. Repeated keys need
``json_values.last_key_wins`` around the plan; without it they are no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import json_values as jv
from lumenframe.functions import text as tx

#: Schema names and words of the protocol, and the keys under which its parts may stand.
RUBRIC_SCHEMA, PAIR_SCHEMA = "judge-rubric-v1", "judge-pair-v1"
CONFIDENCE, DECISIONS = ("low", "medium", "high"), ("A", "B", "TIE", "NEITHER")
NAME_KEYS, QUOTE_KEYS, SIDE_KEYS = ("criterion_id", "id", "key"), ("quote", "text"), ("candidate", "label")
RUBRIC = "struct<error:string,abstain:boolean,criteria:map<string,struct<observed:boolean,confidence:string,evidence:array<string>>>,pruned_evidence:int>"
PAIR = "struct<error:string,decision:string,confidence:string,abstain:boolean,evidence:array<struct<candidate:string,quote:string>>,pruned_evidence:int>"
_QUOTES = "array<struct<candidate:string,quote:string>>"


def _body(raw: Column) -> Column:
    """Without outer white space and one fence of three ticks."""
    bare = tx._stripped(F.coalesce(raw, F.lit("")))
    fenced = (F.length(bare) >= 6) & bare.startswith("```") & bare.endswith("```")
    return F.when(fenced, tx._stripped(F.substring(bare, F.lit(4), F.length(bare) - 6))).otherwise(bare)


def _field(own: Column, *names: str) -> Column:
    """The value of the first of these keys that is there."""
    out = F.when(F.map_contains_key(own, "s" + names[0]), F.try_element_at(own, F.lit("s" + names[0])))
    for n in names[1:]:
        out = out.when(F.map_contains_key(own, "s" + n), F.try_element_at(own, F.lit("s" + n)))
    return out


def _of_kind(v: Column, kind: str) -> Column:
    return tx.once(jv.scalar(v), lambda x: F.when(x["kind"] == kind, x["text"]))


def _text(v: Column) -> Column:
    return _of_kind(v, "string")


def _flag(v: Column) -> Column:
    return _of_kind(v, "bool") == "true"


def _count(v: Column) -> Column:
    """Evidence that was dropped before; what is no number counts none."""
    return F.coalesce(_of_kind(v, "number").try_cast("double").try_cast("int"), F.lit(0))


def _faults(*checks: tuple[Column, str]) -> Column:
    """The text of the first check that does not hold."""
    out = F.lit(None).cast("string")
    for fine, what in reversed(checks):
        out = F.when(~F.coalesce(fine, F.lit(False)), F.lit(what)).otherwise(out)
    return out


def _quotes(evidence: Column) -> Column:
    """Evidence as quotes, null for a quote that is no text; null if it has no shape of evidence."""
    quote = lambda q: F.when(jv.members(q).isNotNull(), _text(_field(jv.members(q), *QUOTE_KEYS))).otherwise(_text(q))
    return F.when(jv.elements(evidence).isNotNull(), F.transform(jv.elements(evidence), quote)).when(_text(evidence).isNotNull(), F.array(_text(evidence)))


def parse_rubric(response: Column, criteria: Column, candidate: Column) -> Column:
    """``criteria``: array of the identifiers that the rubric has; ``candidate``: the judged text (null: empty)."""
    said = F.coalesce(candidate, F.lit(""))

    def entry(e: Column) -> Column:
        own, quotes = jv.members(e["v"]), _quotes(_field(jv.members(e["v"]), "evidence"))
        fault = _faults(
            (own.isNotNull(), "the result is no object"), (_flag(_field(own, "observed")).isNotNull(), "observed is neither true nor false"),
            (_text(_field(own, "confidence")).isin(*CONFIDENCE), "no such confidence"), (quotes.isNull() | ~F.exists(quotes, lambda q: q.isNull()), "a quote is no text"),
        )
        kept = F.filter(quotes, lambda q: F.contains(said, q))
        return F.struct(
            e["name"].alias("name"), F.concat(e["name"], F.lit(": "), fault).alias("fault"), _flag(_field(own, "observed")).alias("observed"), _text(_field(own, "confidence")).alias("confidence"),
            F.coalesce(kept, F.array().cast("array<string>")).alias("evidence"), F.when(quotes.isNull(), 1).otherwise(F.size(quotes) - F.size(kept)).alias("lost"),
        )

    def of(root: Column) -> Column:
        own = jv.members(root)
        given = _field(own, "criteria")
        listed = F.transform(jv.elements(given), lambda v: F.struct(_text(_field(jv.members(v), *NAME_KEYS)).alias("name"), v.alias("v")))
        mapped = F.transform(F.map_entries(jv.members(given)), lambda e: F.struct(F.substring(e["key"], F.lit(2), F.length(e["key"])).alias("name"), e["value"].alias("v")))
        found = F.coalesce(listed, mapped)
        names = F.transform(found, lambda e: e["name"])
        wanted = F.array_distinct(criteria)
        first = _faults(
            (F.to_json(root).isNotNull(), "the response is no JSON"), (_text(_field(own, "schema_version")) == RUBRIC_SCHEMA, "the response has another schema"),
            (_flag(_field(own, "abstain")).isNotNull(), "abstain is neither true nor false"), (found.isNotNull(), "there are no criteria"),
            (~F.exists(F.coalesce(jv.elements(given), F.array().cast("array<variant>")), lambda v: jv.members(v).isNull()), "a listed result is no object"),
            (~F.exists(names, lambda n: n.isNull()) & (F.size(F.array_distinct(names)) == F.size(names)), "results lack names of their own"),
            ((F.size(F.array_except(wanted, names)) == 0) & (F.size(names) == F.size(wanted)), "other criteria than the rubric's"),
        )

        def judged(entries: Column) -> Column:
            fault = F.coalesce(first, F.get(F.filter(F.transform(entries, lambda e: e["fault"]), lambda x: x.isNotNull()), F.lit(0)))
            results = F.map_from_arrays(F.transform(entries, lambda e: e["name"]), F.transform(entries, lambda e: F.struct(e["observed"].alias("observed"), e["confidence"].alias("confidence"), e["evidence"].alias("evidence"))))
            lost = _count(_field(own, "pruned_evidence")) + F.aggregate(entries, F.lit(0), lambda a, e: a + e["lost"])
            return tx.once(fault, lambda bad: F.when(bad.isNotNull(), F.struct(bad, F.lit(None), F.lit(None), F.lit(None)).cast(RUBRIC)).otherwise(F.struct(bad, _flag(_field(own, "abstain")), results, lost).cast(RUBRIC)))

        return tx.once(F.when(first.isNull(), F.transform(found, entry)), judged)

    return tx.once(jv.tagged(_body(response)), of)


def _named_quotes(evidence: Column) -> Column:
    """Evidence of a pair as (candidate, quote): from a list of objects, one object, or a map from candidates to quotes; null if it is none of these."""
    pair = lambda side, quote: F.struct(side.alias("candidate"), quote.alias("quote"))
    one = lambda own: pair(_text(_field(own, *SIDE_KEYS)), _text(_field(own, *QUOTE_KEYS)))
    has = lambda own, keys: F.coalesce(F.map_contains_key(own, "s" + keys[0]) | F.map_contains_key(own, "s" + keys[1]), F.lit(False))
    whole = jv.members(evidence)

    def named(e: Column) -> Column:
        label, own = F.substring(e["key"], F.lit(2), F.length(e["key"])), jv.members(e["value"])
        side = F.when(F.coalesce(F.map_contains_key(own, "scandidate"), F.lit(False)), _text(_field(own, "candidate"))).otherwise(label)
        return pair(side, F.when(own.isNotNull(), _text(_field(own, *QUOTE_KEYS))).otherwise(_text(e["value"])))

    return F.when(jv.elements(evidence).isNotNull(), F.transform(jv.elements(evidence), lambda v: one(jv.members(v)))).when(
        has(whole, SIDE_KEYS) & has(whole, QUOTE_KEYS), F.array(one(whole))
    ).when(whole.isNotNull(), F.transform(F.map_entries(whole), named)).cast(_QUOTES)


def parse_pair(response: Column, a: Column, b: Column) -> Column:
    """``a``, ``b``: the two judged texts (null: empty)."""

    def of(root: Column) -> Column:
        own = jv.members(root)
        fault = _faults(
            (F.to_json(root).isNotNull(), "the response is no JSON"), (_text(_field(own, "schema_version")) == PAIR_SCHEMA, "the response has another schema"),
            (_flag(_field(own, "abstain")).isNotNull(), "abstain is neither true nor false"), (_text(_field(own, "decision")).isin(*DECISIONS), "no such decision"),
            (_text(_field(own, "confidence")).isin(*CONFIDENCE), "no such confidence"),
        )
        found = _named_quotes(_field(own, "evidence"))
        text = lambda q: F.when(q["candidate"] == "A", F.coalesce(a, F.lit(""))).when(q["candidate"] == "B", F.coalesce(b, F.lit("")))
        kept = F.coalesce(F.filter(found, lambda q: F.coalesce(F.contains(text(q), q["quote"]), F.lit(False))), F.array().cast(_QUOTES))
        lost = _count(_field(own, "pruned_evidence")) + F.when(found.isNull(), 1).otherwise(F.size(found) - F.size(kept))
        fine = F.struct(F.lit(None).cast("string"), _text(_field(own, "decision")), _text(_field(own, "confidence")), _flag(_field(own, "abstain")), kept, lost).cast(PAIR)
        return tx.once(fault, lambda bad: F.when(bad.isNotNull(), F.struct(bad, *[F.lit(None)] * 5).cast(PAIR)).otherwise(fine))

    return tx.once(jv.tagged(_body(response)), of)
