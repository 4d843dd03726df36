"""JSON outputs as values, in the JVM.

Spark's variants forget how a number was written (1.0 and 1 are one value), which
graders tell apart. So scalars are tagged before parsing: every string and key
begins with ``s``, numbers and truth values become strings of their spelling.
What is parsed then holds strings, nulls, arrays and objects only, and
``to_json`` of it has its keys in order: a canonical form.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import text as tx

#: Stand for an escaped backslash and an escaped quote while strings are cut out; no JSON holds them unescaped.
_BACKSLASH, _QUOTE = "\x01", "\x02"
_NUMBER = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?"
SCALAR = "struct<kind:string,text:string>"


def nfc(t: Column) -> Column:
    """Composed Unicode form; a text in ASCII is left as it is."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(False))
    return F.when(t.rlike(r"[^\x00-\x7F]"), composed).otherwise(t)


def last_key_wins(spark: SparkSession, build):
    """``build()`` with repeated keys of JSON objects allowed (the last one counts), as the parser is told while a plan is made."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return build()
    finally:
        spark.conf.set(name, before)


def body(t: Column) -> Column:
    """The JSON text of an output: one fence around all of it may stand."""
    fenced = r"(?s)^```(?:json)?\s*\n?(.*?)\n?```$"

    def of(clean: Column) -> Column:
        return F.when(clean.startswith("```") & clean.rlike(fenced), tx.once(F.regexp_extract(clean, fenced, 1), tx.normalised)).otherwise(clean)

    return tx.once(cleaned(t), of)


def cleaned(t: Column) -> Column:
    """Composed, with line feeds for line ends, without outer white space; a null is empty. Each step's text is computed once."""
    return tx.once(tx.once(F.coalesce(t, F.lit("")), nfc), tx.normalised)


def tagged(t: Column) -> Column:
    """A variant of the tagged JSON; null if the text is no JSON."""

    def of(t: Column) -> Column:
        hidden = F.replace(F.replace(t, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
        named = F.regexp_replace(hidden, '"([^"]*+)"', '"s$1"')
        spelled = F.regexp_replace(named, rf'"([^"]*+)"|(?<![\w.+-])({_NUMBER}|true|false)(?![\w.+-])', '"$1$2"')
        shown = F.replace(F.replace(spelled, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
        # the parser stops at the end of a value: an element behind it, of a spelling that no tagged text has, shows that the value is all there is
        both = F.try_parse_json(F.concat(F.lit("["), shown, F.lit(',"e"]')))
        alone = tx.once(both, lambda b: F.when(F.try_variant_get(b, "$[1]", "string") == "e", F.try_variant_get(b, "$[0]", "variant")))
        return F.when(~t.rlike(r"[\x01\x02]"), alone)

    return tx.once(t, of)


def members(v: Column) -> Column:
    """map<string, variant> of an object (keys with their tag); null of anything else."""
    return v.try_cast("map<string,variant>")


def elements(v: Column) -> Column:
    """array<variant> of an array; null of anything else."""
    return F.when(F.to_json(v).startswith("["), v.try_cast("array<variant>"))


def at(v: Column, path: Column) -> Column:
    """The value at a path of keys; null if there is none."""
    return F.aggregate(path, v, lambda a, k: F.try_element_at(members(a), F.concat(F.lit("s"), k)))


def scalar(v: Column) -> Column:
    """(kind, text): string, number, bool, null, or deep with its text to compare by; null if there is no value."""
    as_is = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    def plain(said: Column) -> Column:
        return F.when(said.startswith("s"), as_is("string", F.substring(said, F.lit(2), F.length(said)))).when(said.isin("true", "false"), as_is("bool", said)).otherwise(as_is("number", said))

    def of(json: Column) -> Column:
        return F.when(json.isNull(), F.lit(None).cast(SCALAR)).when(json == "null", as_is("null", F.lit("null"))).when(F.left(json, F.lit(1)).isin("{", "["), as_is("deep", comparable(json))).otherwise(tx.once(v.try_cast("string"), plain))

    return tx.once(F.to_json(v), of)


_SPELLED = r'(?<=^|[\[{,:])"((?:-?\d)[^"]*+|true|false)"'


def _respelled(json: Column, spell) -> Column:
    """A canonical text with its numbers and truth values written anew by ``spell``."""

    def of(json: Column) -> Column:
        gaps, found = F.split(json, _SPELLED, -1), F.regexp_extract_all(json, F.lit(_SPELLED), F.lit(1))
        put = F.concat(F.transform(found, spell), F.array(F.lit("")))
        return F.when(json.rlike(_SPELLED), F.array_join(F.zip_with(gaps, put, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")).otherwise(json)

    return tx.once(json, of)


def comparable(json: Column) -> Column:
    """Numbers by value and truth values as 0 and 1: equal texts are equal values."""
    return _respelled(json, lambda n: F.when(n == "true", "1.0").when(n == "false", "0.0").otherwise(n.cast("double").cast("string")))


def canonical(t: Column) -> Column:
    """The class of a JSON text: keys in order, no blanks, whole numbers by their digits, others by value; UNPARSEABLE if it is no JSON."""
    number = lambda n: F.when(n.isin("true", "false"), n).when(n.rlike("[.eE]"), n.cast("double").cast("string")).when(n == "-0", "0").otherwise(n)
    shown = _respelled(F.to_json(tagged(t)), number)
    untagged = F.regexp_replace(F.replace(F.replace(shown, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE)), '"s([^"]*+)"', '"$1"')
    return F.coalesce(F.replace(F.replace(untagged, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\")), F.lit("UNPARSEABLE"))
