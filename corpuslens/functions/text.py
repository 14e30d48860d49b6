"""Column functions on text: cleaning, lexicon tests, label parsing. All run inside the JVM.

Patterns start with (?U) so that white space and word characters are Unicode's.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"https?://\S+"
TAG = r"<[^>]+>"


def strip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def nonblank(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def light_clean(c: Column, promo: Sequence[str] = ()) -> Column:
    """struct(text, url_removed, html_removed, promo_trim, space_norm). URLs become <URL>, which the
    tag pattern then counts and replaces once more, as the counts are defined. promo_trim counts the
    patterns that changed the text, space_norm says whether white space did; blank texts count 0."""
    text = F.coalesce(c, F.lit(""))
    urls = F.regexp_count(text, F.lit("(?U)" + URL))
    text = F.regexp_replace(text, "(?U)" + URL, "<URL>")
    tags = F.regexp_count(text, F.lit(TAG))
    text = F.regexp_replace(text, TAG, "<HTML>")
    cut = F.lit(0)
    for p in promo:
        trimmed = F.regexp_replace(text, p, "")
        cut = cut + (trimmed != text).cast("int")
        text = trimmed
    clean = collapse(text)
    changed = ((clean != text) & (clean != "")).cast("int")
    return F.struct(clean.alias("text"), urls.alias("url_removed"), tags.alias("html_removed"), cut.alias("promo_trim"), changed.alias("space_norm"))


def preprocess(c: Column) -> Column:
    """Without URLs, mentions and tags; white space collapsed."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)" + URL, "")
    return collapse(F.regexp_replace(F.regexp_replace(c, r"(?U)@\w+", ""), TAG, ""))


def any_term(c: Column, terms: Sequence[str]) -> Column:
    """True if any term occurs in the text."""
    return c.rlike("|".join(re.escape(t) for t in terms)) if terms else F.lit(False)


def terms_in(c: Column, terms: Sequence[str]) -> Column:
    """The terms that occur, in the lexicon's order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t))


def unit_role(c: Column, quote: str, claim: str) -> Column:
    return F.when(c.rlike(quote), "quote").when(c.rlike(claim), "claim").otherwise("context")


def event_phase(c: Column, phases: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first phase one of whose terms occurs; else empty."""
    out = None
    for name, terms in phases:
        out = F.when(any_term(c, terms), name) if out is None else out.when(any_term(c, terms), name)
    return out.otherwise("")


def parse_labels(c: Column, sep: str = "|") -> Column:
    """A delimited cell as an array of trimmed, non-blank labels; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), re.escape(sep)), lambda x: strip(x)), lambda x: x != "")


def label_code(c: Column, pattern: str = r"^(L1-\d+)") -> Column:
    """The code at the start, or the raw label."""
    code = F.regexp_extract(c, pattern, 1)
    return F.when(code != "", code).otherwise(c)


def truncate_before(c: Column, marker: str) -> Column:
    at = F.instr(c, marker)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)


def short_hash(c: Column, n: int = 12) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, n)


def surrogate_key(source: Column, url: Column, title: Column, content: Column) -> Column:
    """source_hash from url, title and the content's first 100 characters."""
    return F.concat_ws("_", F.coalesce(source, F.lit("")), short_hash(F.concat(F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.substring(F.coalesce(content, F.lit("")), 1, 100))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two label arrays as sets; two empty ones give 1."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def ordered_rules(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The first rule's value that holds."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def interval_label(c: Column, bounds: Sequence[tuple[str, str]], after: str, missing: str) -> Column:
    """The first label whose (exclusive) upper bound lies beyond c: phases of a calendar."""
    return ordered_rules([(c.isNull(), missing), *[(c < F.lit(b).cast("date"), name) for b, name in bounds]], after)


def strip_lead_timestamps(c: Column, pattern: str = r"\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}", within: int = 200) -> Column:
    """What follows the last time stamp that ends within the first characters; else the text."""
    lead = F.regexp_extract(F.substring(c, 1, within), f"(?s)^(.*{pattern})", 1)
    return F.when(lead != "", strip(F.substring(c, F.length(lead) + 1, F.length(c)))).otherwise(c)


def strong_keys(c: Column, strong: Sequence[str], anti: Sequence[str]) -> Column:
    """Whether a strong term occurs, and none of the terms that only look like one."""
    c = F.coalesce(c, F.lit(""))
    return ~any_term(c, anti) & any_term(c, strong)


def substring_label(c: Column, rules: Sequence[tuple[Sequence[str], str]], otherwise: str | Column, blank: str | None = None) -> Column:
    """The first rule one of whose parts occurs in the text or in its lower case."""
    c = F.coalesce(c, F.lit(""))
    both = F.concat_ws("\n", c, F.lower(c))
    out = F.when(any_term(both, rules[0][0]), rules[0][1])
    for parts, value in rules[1:]:
        out = out.when(any_term(both, parts), value)
    if blank is not None:
        out = out.when(strip(c) == "", blank)
    return out.otherwise(otherwise)


def display(c: Column, names: dict[str, str]) -> Column:
    """The name to show for a key, or the key."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def without_suffix(c: Column, suffix: str = ".csv") -> Column:
    c = strip(c)
    return F.when(F.lower(c).endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def file_safe(c: Column, most: int = 80, bad: str = '<>:"/\\|?*\n\r\t ') -> Column:
    """A text as part of a file name: bad characters become underscores, and it ends after ``most``."""
    return F.substring(F.translate(c, bad, "_" * len(bad)), 1, most)


def parse_date(c: Column, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyyMMdd")) -> Column:
    """The time that any of the formats reads, null if none does; a zone is dropped."""
    bare = F.regexp_replace(strip(c.cast("string")), r"(Z|[+-]\d{2}:?\d{2})$", "")
    bare = F.when(bare.rlike(r"^\d{4}-\d{2}$"), None).otherwise(bare)
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def period(c: Column, missing: str = "_nodate") -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM"), F.lit(missing))


def percent(c: Column, digits: int = 1) -> Column:
    """A share in per cent, rounded half to even."""
    return F.bround(c.cast("double") * 100, digits)


def p_display(p: Column) -> Column:
    """A p value as it is printed: four places, or its exponent where they would show nothing."""
    small = F.format_string("%.2e", p)
    return F.when(p.isNull() | F.isnan(p), "NA").when(p < 1e-8, F.concat(F.lit("<1e-8 (exact "), small, F.lit(")"))).when(p < 1e-4, small).otherwise(F.format_string("%.4f", p))


def hash_int(c: Column, digits: int = 12) -> Column:
    """The first hex digits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, digits), 16, 10).cast("long")


def memo_key(c: Column, most: int = 256) -> Column:
    """The key by which a model's answer on the first characters of a text is remembered."""
    return F.md5(F.substring(F.coalesce(c, F.lit("")), 1, most).cast("binary"))
