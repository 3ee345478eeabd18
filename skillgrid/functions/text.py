"""Column functions for advert and module text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python counts as white space; the class works in Java and RE2 alike.
WS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty, else ''."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def squeeze(c: Column) -> Column:
    """White space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(c), WS + "+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), f"^{WS}+|{WS}+$", "")


def normalise_text(c: Column) -> Column:
    """Lower case, everything outside a-z and 0-9 is a separator."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", " "))


def fingerprint(title, company, recruiter, location, reference, description) -> Column:
    parts = [normalise_text(c) for c in (title, company, recruiter, location, reference)]
    parts.append(normalise_text(description))  # the whole text: adverts that differ late are different
    return F.sha2(F.concat_ws("|", *parts), 256)


def joined_text(*parts: Column) -> Column:
    """Non-empty parts separated by a blank line."""
    return F.concat_ws("\n\n", *[blank_to_null(p.cast("string")) for p in parts])


def merge_content(pasted: Column, parsed: Column) -> Column:
    return joined_text(strip(pasted), strip(parsed))


def compact_text(c: Column, limit: int) -> Column:
    """Squeezed text; when too long it is cut before the last word and marked."""
    def shorten(flat):
        cut = F.trim(F.regexp_replace(F.left(flat, F.lit(limit)), " [^ ]*$", ""))
        return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("...")))

    return let(squeeze(c), shorten)


def strip_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(text_or_empty(c), "<[^>]+>", " "))


def clamp_text(c: Column, limit: int) -> Column:
    """Keep 70 % of the limit from the head and the rest from the tail of an overlong text."""
    body = text_or_empty(c)
    head = int(limit * 0.70)
    omitted = (F.length(body) - limit).cast("string")
    long_form = F.concat(
        F.regexp_replace(F.left(body, F.lit(head)), f"{WS}+$", ""),
        F.lit("\n\n[... "), omitted,
        F.lit(" characters omitted to stay inside the model context window ...]\n\n"),
        F.regexp_replace(F.right(body, F.lit(limit - head)), f"^{WS}+", ""),
    )
    return F.when(F.length(body) <= limit, body).otherwise(long_form)


def salary_text(low: Column, high: Column) -> Column:
    has_low, has_high = F.coalesce(low, F.lit(0)) != 0, F.coalesce(high, F.lit(0)) != 0
    return (
        F.when(has_low & has_high, F.concat_ws("-", low.cast("string"), high.cast("string")))
        .when(has_low, F.concat(F.lit("from "), low.cast("string")))
        .when(has_high, F.concat(F.lit("up to "), high.cast("string")))
        .otherwise("Unknown")
    )


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def lenient_double(c: Column) -> Column:
    plain = strip(c)
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))


def lenient_int(c: Column) -> Column:
    """Thousands separators are dropped, fractions are truncated, anything else is null."""
    return lenient_double(F.regexp_replace(text_or_empty(c), ",", "")).try_cast("bigint")


_WEEKDAY = r"(?i)^(monday|tuesday|wednesday|thursday|friday|saturday|sunday),\s*"


def parse_date(c: Column) -> Column:
    """Dates written 'Monday, May 20, 2024', 'May 20, 2024', '20 May 2024' or ISO with any tail."""
    def read(raw):
        spoken = F.regexp_replace(raw, _WEEKDAY, "")
        iso = F.left(raw, F.lit(10))
        # a text has one of these forms at most; the usual one comes first
        return F.coalesce(
            F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso).try_cast("date"),
            F.try_to_date(F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), raw), "yyyy-M-d"),
            F.try_to_date(F.when(iso.rlike(r"^\d{8}$"), iso), "yyyyMMdd"),
            F.try_to_date(F.when(raw.rlike(r"^\d{1,2} \p{L}+ \d{4}$"), raw), "d MMMM yyyy"),
            F.try_to_date(F.when(spoken.rlike(r"^\p{L}+ \d{1,2}, \d{4}$"), spoken), "MMMM d, yyyy"),
        )

    return let(F.left(strip(c), F.lit(40)), read)


def first_wins(values: Column, key) -> Column:
    """Array without later elements whose key occurred before; order is kept."""
    def kept(p):
        numbered = F.transform(p["v"], lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        return F.transform(F.filter(numbered, lambda e: F.array_position(p["k"], key(e["v"])) == e["i"] + 1), lambda e: e["v"])

    return let(let(values, lambda v: F.struct(v.alias("v"), F.transform(v, key).alias("k"))), kept)


def typed_list(c: Column, canonical) -> Column:
    """Split a typed list on comma, semicolon or line break; canonical names, first one wins."""
    names = F.transform(F.split(text_or_empty(c), r"[,;]|" + LINE_BREAK), canonical)
    return F.array_distinct(F.filter(names, lambda s: s != ""))


def unique_strings(values: Column) -> Column:
    """Squeezed strings, case-insensitively unique, first spelling kept."""
    flat = F.filter(F.transform(values, squeeze), lambda s: s != "")
    return first_wins(flat, F.lower)


def words(c: Column) -> Column:
    """Tokens of the text model: a-z and 0-9 only."""
    return F.filter(F.split(normalise_text(c), " "), lambda t: t != "")


def join_names(names: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return (
        F.when(n == 0, "")
        .when(n == 1, F.try_element_at(names, F.lit(1)))
        .otherwise(F.concat(head, F.lit(" and "), F.try_element_at(names, F.lit(-1))))
    )
