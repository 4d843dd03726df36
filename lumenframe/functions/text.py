"""Text predicates for grading, as column expressions over a normalised text.

Each constraint kind is a function of the text column and its parameters, by
the names that grading specifications use, that gives a boolean column: true if the constraint holds. ``CONSTRAINTS`` is the
dispatch table; an unknown kind never holds.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a class for Java's regular expressions.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)


def once(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` may use it often and it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalised(t: Column) -> Column:
    """Line ends become line feeds, outer white space goes. (Composed form: ``json_values.nfc`` before, where it matters.)"""
    lines = F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t)
    # most texts have no outer white space: their ends tell
    open_ended = F.left(t, F.lit(1)).rlike(SPACE) | F.right(t, F.lit(1)).rlike(SPACE)
    return F.when(open_ended, F.regexp_replace(lines, f"^{SPACE}+|{SPACE}+$", "")).otherwise(lines)


def words(t: Column) -> Column:
    return F.array_remove(F.split(t, f"{SPACE}+"), "")


def lines(t: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE))


def sentences(t: Column) -> Column:
    return F.filter(F.split(t, rf"(?<=[.!?]){SPACE}+"), lambda x: x.rlike(NOT_SPACE))


def bullets(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda x: x.rlike(rf"^{SPACE}*[-*•]{SPACE}+"))


def bullet_text(x: Column) -> Column:
    """What stands after the marks and blanks at the start; other white space is text."""
    return F.ltrim(x, F.lit("-*• "))


def numbered_items(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(rf"(?md)^{SPACE}*\d+\.{SPACE}+(.*)$"), F.lit(1))


def occurrences(t: Column, term: str) -> Column:
    """Non-overlapping, in either case."""
    return F.regexp_count(t, F.lit(f"(?iu){quote(term)}"))


def quote(term: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|\-#&])", r"\\\1", term)


def has(t: Column, term: str) -> Column:
    return F.contains(F.lower(t), F.lit(term.lower()))


def term_matches(t: Column, term: str, how: str = "substring") -> Column:
    """A whole word, or any substring, in either case. (Letters, digits and the underscore make words.)"""
    if how == "word":
        return t.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){quote(term)}(?![\p{{L}}\p{{N}}_])")
    if how == "substring":
        return t.rlike(f"(?iu){quote(term)}")
    raise ValueError(f"no such way to match: {how}")


def _bare(w: Column) -> Column:
    return F.rtrim(w, F.lit(".,;:"))


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def _item(c: dict, values: Column) -> Column:
    """The element that a constraint names, counted from 1; null if there is none."""
    return F.get(values, F.lit(int(c["index"]) - 1)) if int(c["index"]) > 0 else F.lit(None).cast("string")


def _bullet(c: dict, t: Column) -> Column:
    """A bullet's text; index -1 is the last one."""
    found = bullets(t)
    return bullet_text(F.try_element_at(found, F.lit(-1)) if int(c["index"]) == -1 else _item(c, found))


def _endings(x: Column) -> Column:
    return F.regexp_count(x, F.lit(rf"[.!?]+(?:{SPACE}|$)"))


def _item_sentences(t: Column, c: dict) -> Column:
    items = numbered_items(t)
    if "index" in c:
        return _endings(_item(c, items)) == int(c["value"])
    return (F.size(items) > 0) & F.forall(items, lambda x: _endings(x) == int(c["value"]))


def _sentence_terms(t: Column, c: dict) -> Column:
    terms = [*(c.get("terms") or []), *([c["term"]] if "term" in c else [])]
    if c.get("all_sentences"):
        return F.forall(sentences(t), lambda s: has(s, terms[0] if terms else ""))
    return _all([has(_item(c, sentences(t)), x) for x in terms]) & _item(c, sentences(t)).isNotNull() if c.get("index") else F.lit(True)


def _table_shape(t: Column, c: dict) -> Column:
    """A header of these cells, a separator, and that many rows of data."""
    rows = F.filter(F.split(t, "\n"), lambda r: r.rlike(rf"^{SPACE}*\|"))
    header = F.transform(F.split(F.regexp_replace(F.get(rows, F.lit(0)), r"^\|+|\|+$", ""), r"\|"), _stripped)
    data = F.filter(F.slice(rows, 3, F.greatest(F.size(rows), F.lit(1))), lambda r: ~r.rlike(rf"^{SPACE}*\|?(?:{SPACE}|[:|-])+\|?{SPACE}*$"))
    return (F.size(rows) >= 3) & (header == F.array(*[F.lit(x) for x in c["columns"]])) & (F.size(data) == c["data_rows"])


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def plain(s: str) -> str:
    """What ``normalised`` and the composed form make of a constant."""
    return re.sub(r"\r\n?", "\n", unicodedata.normalize("NFC", s)).strip()


def json_strings(t: Column) -> Column:
    """The values of a JSON object that are strings; null if the text is no JSON object."""
    from lumenframe.functions import json_values as jv

    values = F.transform(F.map_values(jv.members(jv.tagged(jv.body(t)))), jv.scalar)
    return F.transform(F.filter(values, lambda x: x["kind"] == "string"), lambda x: x["text"])


def _term_count(t: Column, c: dict) -> Column:
    how = c.get("occurrence", "exactly")
    if how == "across_values":
        return F.size(F.filter(json_strings(t), lambda x: term_matches(x, c["term"], c.get("match", "substring")))) == c["count"]
    return occurrences(t, c["term"]) == c["count"] if how == "exactly" else F.lit(True)


CONSTRAINTS = {
    "word_count": lambda t, c: F.size(words(t)) == c["value"],
    "word_range": lambda t, c: F.size(words(t)).between(c["min"], c["max"]),
    "word_limit": lambda t, c: F.size(words(t)) <= c["max"],
    "first_word": lambda t, c: _bare(F.get(words(t), F.lit(0))) == c["word"],
    "last_word": lambda t, c: _bare(F.try_element_at(words(t), F.lit(-1))) == c["word"],
    "term_occurrence": _term_count,
    "forbidden_terms": lambda t, c: _all([~term_matches(t, x) for x in c["terms"]]),
    "allowed_punctuation": lambda t, c: ~F.regexp_replace(t, r"(?md)^[A-F]\.", "").rlike(r"[^\p{L}\p{N}" + SPACE[1:]),
    "forbidden_chars": lambda t, c: _all([~F.contains(t, F.lit(x)) for x in c["chars"]]),
    "required_terms": lambda t, c: _all([has(t, x) for x in c["terms"]]),
    "first_prefix": lambda t, c: _stripped(F.get(F.split(t, "\n"), F.lit(0))).startswith(c["prefix"]),
    "parenthetical_count": lambda t, c: (F.regexp_count(t, F.lit(r"\(")) == c["value"]) & (F.regexp_count(t, F.lit(r"\)")) == c["value"]),
    "bullet_count": lambda t, c: F.size(bullets(t)) == c["value"],
    "numbered_list_count": lambda t, c: F.regexp_count(t, F.lit(rf"(?md)^{SPACE}*\d+[.)]{SPACE}+")) == c["value"],
    "item_prefix": lambda t, c: _item(c, numbered_items(t)).startswith(c["prefix"]),
    "item_contains": lambda t, c: F.contains(_item(c, numbered_items(t)), F.lit(c["term"])),
    "item_excludes_chars": lambda t, c: _item(c, numbered_items(t)).isNotNull() & _all([~F.contains(_item(c, numbered_items(t)), F.lit(x)) for x in c["chars"]]),
    "item_sentence_count": _item_sentences,
    "sentence_count": lambda t, c: F.size(sentences(t)) == c["value"],
    "sentence_contains": _sentence_terms,
    "sentence_numeric_tokens": lambda t, c: F.regexp_count(_item(c, sentences(t)), F.lit(r"\d+(?:\.\d+)?")).between(c["min"], c["max"]),
    "sentence_is_question": lambda t, c: _stripped(_item(c, sentences(t))).endswith("?"),
    "markdown_table_shape": _table_shape,
    "trailing_literal": lambda t, c: _stripped(t).endswith(c["literal"]),
    "line_count": lambda t, c: F.size(lines(t)) == c["value"],
    "line_prefix_sequence": lambda t, c: _all([_stripped(F.get(lines(t), F.lit(i))).startswith(p) for i, p in enumerate(c["prefixes"])]),
    "line_word_limit": lambda t, c: F.forall(lines(t), lambda x: F.size(words(x)) <= c["max_words"]),
    "line_contains": lambda t, c: _all([has(F.get(lines(t), F.lit(ord(x) - ord("A"))), c["term"]) for x in c["lines"]]),
    "bullet_prefix": lambda t, c: _bullet(c, t).startswith(c["prefix"]),
    "bullet_word_limit": lambda t, c: F.forall(bullets(t), lambda x: F.size(words(bullet_text(x))) <= c["max_words"]),
    "ends_with": lambda t, c: _stripped(t).endswith(c["suffix"]),
    "required_prefix": lambda t, c: t.startswith(c["prefix"]),
}


def holds(t: Column, constraint: dict) -> Column:
    """Whether a normalised text meets a constraint; a missing part (no such item) does not."""
    make = CONSTRAINTS.get(constraint["kind"])
    return F.coalesce(make(t, constraint), F.lit(False)) if make else F.lit(False)


def violated_kinds(t: Column, constraints: list[dict]) -> Column:
    """The kinds that do not hold, in the order given. ``t`` is computed once."""
    return once(t, lambda x: F.filter(F.array(*[F.when(~holds(x, c), F.lit(c["kind"])) for c in constraints]), lambda y: y.isNotNull()))


def _said(what: str, n: Column) -> Column:
    return F.array(F.concat(F.lit(what), n.cast("string"), F.lit(" found")))


def _of_each(c: dict, key: str, bad) -> Column:
    """One violation per term of a list that breaks the rule."""
    return F.filter(F.array(*[F.when(bad(x), F.lit(f"{c['kind']}: {x!r}")) for x in c[key]]), lambda y: y.isNotNull())


def _of_lines(kind: str, values: Column, bad) -> Column:
    """One violation per line or bullet that breaks the rule, by its number."""
    return F.filter(F.transform(values, lambda x, i: F.when(bad(x), F.concat(F.lit(f"{kind}: number "), (i + 1).cast("string")))), lambda y: y.isNotNull())


#: What was found, by kind: an array of texts that start with the kind. Other kinds say that they are not met.
FOUND = {
    **{k: (lambda t, c: _said(f"{c['kind']}: ", F.size(words(t)))) for k in ("word_count", "word_range", "word_limit")},
    "sentence_count": lambda t, c: _said("sentence_count: ", F.size(sentences(t))),
    "bullet_count": lambda t, c: _said("bullet_count: ", F.size(bullets(t))),
    "numbered_list_count": lambda t, c: _said("numbered_list_count: ", F.regexp_count(t, F.lit(rf"(?md)^{SPACE}*\d+[.)]{SPACE}+"))),
    "line_count": lambda t, c: _said("line_count: ", F.size(lines(t))),
    "first_word": lambda t, c: F.array(F.concat(F.lit("first_word: "), F.coalesce(F.get(words(t), F.lit(0)), F.lit("none")))),
    "last_word": lambda t, c: F.array(F.concat(F.lit("last_word: "), F.coalesce(F.try_element_at(words(t), F.lit(-1)), F.lit("none")))),
    "term_occurrence": lambda t, c: _said(f"term_occurrence({c['term']!r}): ", occurrences(t, c["term"])),
    "forbidden_terms": lambda t, c: _of_each(c, "terms", lambda x: term_matches(t, x)),
    "required_terms": lambda t, c: _of_each(c, "terms", lambda x: ~has(t, x)),
    "forbidden_chars": lambda t, c: _of_each(c, "chars", lambda x: F.contains(t, F.lit(x))),
    "line_contains": lambda t, c: _of_each(c, "lines", lambda x: ~F.coalesce(has(F.get(lines(t), F.lit(ord(x) - ord("A"))), c["term"]), F.lit(False))),
    "line_word_limit": lambda t, c: _of_lines("line_word_limit", lines(t), lambda x: F.size(words(x)) > c["max_words"]),
    "bullet_word_limit": lambda t, c: _of_lines("bullet_word_limit", bullets(t), lambda x: F.size(words(bullet_text(x))) > c["max_words"]),
    "line_prefix_sequence": lambda t, c: F.filter(
        F.array(*[F.when(~F.coalesce(_stripped(F.get(lines(t), F.lit(i))).startswith(p), F.lit(False)), F.lit(f"line_prefix_sequence: line {i + 1}")) for i, p in enumerate(c["prefixes"])]),
        lambda y: y.isNotNull(),
    ),
}


def violations(t: Column, constraints: list[dict]) -> Column:
    """Everything that breaks a constraint, in the order given: each text starts with its kind and says what was found."""

    def of(x: Column, c: dict) -> Column:
        found = FOUND.get(c["kind"], lambda t, c: F.array(F.lit(f"{c['kind']}: not met")))(x, c)
        return F.when(holds(x, c), F.array().cast("array<string>")).otherwise(found)

    return once(t, lambda x: F.flatten(F.array(*[of(x, c) for c in constraints])))


def excerpt(t: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(t, 1, n)


def slug(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), F.lit("_"))


def time_parts(t: Column, single_digit: bool = False, meridiem: bool = False) -> Column:
    """(h, m, s) of a clock time in the listed forms, else null; no range check."""
    pattern = r"(?i)^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(am|pm|a\.m\.|p\.m\.)?\s*$"
    part = lambda i: F.regexp_extract(t, pattern, i)
    hour, mark = part(1).cast("int"), F.lower(F.replace(part(4), F.lit("."), F.lit("")))
    hour = F.when((mark == "pm") & (hour != 12), hour + 12).when((mark == "am") & (hour == 12), 0).otherwise(hour)
    fine = t.rlike(pattern)
    if not single_digit:
        fine = fine & (F.length(part(1)) == 2)
    if not meridiem:
        fine = fine & (part(4) == "")
    second = F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0))
    return F.when(fine, F.struct(hour.alias("h"), part(2).cast("int").alias("m"), second.alias("s")))


def bare_number(t: Column) -> Column:
    """The number if the text is one, end marks aside; else null."""
    cleaned = F.trim(F.regexp_replace(t, r"[.!?]+$", ""))
    return F.when(cleaned.rlike(r"^[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?$"), cleaned.cast("double"))


def close_to(a: Column, b: Column, absolute: float = 0.0, relative: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.abs(b))


def is_json_number(t: Column) -> Column:
    return t.rlike(r"^\s*-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?\s*$")


def stop_tokens(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r'(?m)^\s*stop\s+"(.*)"'), F.lit(1)))


def content_id(*parts: Column) -> Column:
    """sha256 of parts joined by a bar; a null part reads None."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256)


def synthetic_documents(archetypes, sizes: tuple[int, ...]):
    """A document of each archetype (a: int, name) and size, with one marked word in a known place: rows of (doc_id, archetype, length, n_words, text)."""
    a, size, i = F.col("a"), F.col("x.n"), F.col("x.i")
    names = F.array(*[F.lit(n) for n in ("S", "M", "L")])
    rows = archetypes.select("a", "name", F.explode(F.array(*[F.struct(F.lit(k).alias("i"), F.lit(n).alias("n")) for k, n in enumerate(sizes)])).alias("x"))
    word = lambda j: F.when(j == (a * 11 + 5) % size, F.concat(F.lit("needle-"), "name")).otherwise(F.concat(F.lit("w"), ((j * 31 + a * 7 + i * 3) % 97).cast("string")))
    return rows.select(
        F.concat(F.lit("LC"), F.lpad((a * len(sizes) + i + 1).cast("string"), 9, "0")).alias("doc_id"), F.concat(F.lit("archetype-"), "name").alias("archetype"),
        F.get(names, i).alias("length"), size.alias("n_words"), F.array_join(F.transform(F.sequence(F.lit(0), size - 1), word), " ").alias("text"),
    )
