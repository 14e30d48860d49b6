"""Rule classifiers: ordered decisions as single expressions, with their reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_term, ordered_rules, strip, strip_lead_timestamps, terms_in, truncate_before


def hard_rule(c: Column, actors: Sequence[str], institutions: Sequence[str], blacklist: Sequence[str]) -> Column:
    """struct(keep, reason): blacklist drops, actor with institution or institution alone keeps. Terms
    are sought in the text as it is and in lower case."""
    both = F.concat_ws("\n", c, F.lower(c))
    black = F.array_min(terms_in(both, sorted(set(blacklist)))) if blacklist else F.lit(None).cast("string")
    actor, inst = any_term(both, actors), any_term(both, institutions)
    keep = F.when(black.isNotNull(), False).otherwise(inst)
    reason = F.when(black.isNotNull(), F.concat(F.lit("blacklist:"), black)).when(actor & inst, "cooccur").when(inst, "institution_only").otherwise("no_hit")
    return F.struct(keep.alias("keep"), reason.alias("reason"))


def bucket_score(c: Column, buckets: Sequence[Sequence[str]]) -> Column:
    """One point for each bucket with a term in the text."""
    out = F.lit(0)
    for terms in buckets:
        out = out + any_term(c, terms).cast("int")
    return out


def policy_gate(c: Column, score: Column, actors, institutions, core, strong, ambiguous: str | None = None) -> Column:
    """struct(pass, reason), the first of: region score, co-occurrence, core term, two institutions,
    strong anchor."""
    odd = c.rlike(ambiguous) if ambiguous else F.lit(False)
    n = F.size(terms_in(F.concat_ws("\n", c, F.lower(c)), list(dict.fromkeys(institutions))))
    reason = ordered_rules([((score >= 2) & ~odd, "region"), (any_term(c, actors) & (n > 0), "cooccur"), (any_term(c, core), "core"), (n >= 2, "institutions"), (any_term(c, strong), "anchor")], "none")
    return F.struct((reason != "none").alias("passed"), reason.alias("reason"), n.alias("inst_cnt"))


def three_way(score: Column, keep: Column | float, drop: Column | float) -> Column:
    return F.when(score >= keep, "KEEP").when(score < drop, "DROP").otherwise("REVIEW")


def final_decision(blacklisted, gate_reason, gate, priority, hard_reason, semantic, nli, nli_score, key_hit) -> Column:
    """The ten ordered rules that join the classifiers' votes."""
    return ordered_rules(
        [
            (blacklisted, "DROP"),
            ((gate_reason == "cooccur") & (nli == "DROP") & (nli_score <= -0.15), "REVIEW"),
            (gate_reason == "cooccur", "KEEP"),
            (priority, "KEEP"),
            (gate, "KEEP"),
            ((hard_reason == "institution_only") & (semantic == "KEEP") & (nli == "KEEP"), "KEEP"),
            (hard_reason == "institution_only", "REVIEW"),
            (nli == "KEEP", "KEEP"),
            ((semantic == "DROP") & key_hit, "REVIEW"),
            (semantic == "DROP", "DROP"),
            ((nli == "DROP") & ((nli_score > 0) | key_hit), "REVIEW"),
            (nli == "DROP", "DROP"),
            (semantic == "KEEP", "KEEP"),
        ],
        "REVIEW",
    )


def priority_bypass(c: Column, score: Column, high: Sequence[str], ambiguous: str | None = None) -> Column:
    """Texts that pass all filters: two region points or a term of high confidence, and no homograph."""
    odd = c.rlike(ambiguous) if ambiguous else F.lit(False)
    return ~odd & ((score >= 2) | any_term(c, high))


def refine_review(
    c: Column, similarity: Column, margin: Column, actors, institutions, blacklist, scarce, symbolic, foreign: Sequence[Sequence[str]] = (), region: Sequence[str] = (), s_min: float = 0.40, m_min: float = 0.10
) -> Column:
    """REVIEW rows to KEEP, CONTEXT or DROP, by ten ordered rules; a missing score counts 0.

    foreign: groups of terms that together speak of elsewhere, unless a term of region occurs.
    """
    s, m = (F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)) for x in (similarity, margin))
    own = any_term(c, actors) | any_term(c, institutions)
    abroad = F.lit(bool(foreign))
    for terms in foreign:
        abroad = abroad & any_term(c, terms)
    return ordered_rules(
        [
            (any_term(c, blacklist) & ~own, "REVIEW_DROP"),
            (abroad & ~any_term(c, region) & ~own, "REVIEW_DROP"),
            (s >= s_min, "REVIEW_KEEP"),
            (own, "REVIEW_KEEP"),
            (m >= m_min, "REVIEW_KEEP"),
            (any_term(c, scarce), "REVIEW_KEEP"),
            (any_term(c, symbolic), "REVIEW_CONTEXT"),
            (s.between(0.30, s_min) & own, "REVIEW_CONTEXT"),
            ((m > 0) & (m < m_min), "REVIEW_CONTEXT"),
        ],
        "REVIEW_DROP",
    )


def clean_article_sentence(
    c: Column, editors: Sequence[str], copyright_from: str, copyright_end: str, byline: str, stamp: str = r"\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}", residue: Sequence[tuple[str, str]] = (), min_chars: int = 10, short: int = 15
) -> Column:
    """struct(sentence, reason): the text of an article's sentence, or null and why it went.

    In order: the text ends before the first of the editors' marks that occurs, then before the
    notice of copyright; long texts that begin with several time stamps and texts that end like the
    notice go; the text begins after the byline, or else after the last time stamp among its first
    characters; then short ones go, and what is left over of an editor's line (residue: pattern, reason).
    """
    text = strip(F.coalesce(c, F.lit("")))
    cut, marked = text, F.lit(False)
    for mark in editors:  # the first mark in the list that occurs
        cut = F.when(~marked & F.contains(text, F.lit(mark)), strip(truncate_before(text, mark))).otherwise(cut)
        marked = marked | F.contains(text, F.lit(mark))
    bare = strip(truncate_before(cut, copyright_from))
    lead = F.regexp_extract(bare, f"(?s)^(.*?{byline})", 1)
    body = F.when(lead != "", strip(F.substring(bare, F.length(lead) + 1, F.length(bare)))).otherwise(strip_lead_timestamps(bare, stamp))
    rules = [
        (text == "", "empty"),
        (cut == "", "editor_mark_empty"),
        (bare == "", "copyright_empty"),
        ((F.length(bare) > 200) & bare.rlike(f"^({stamp}\\s*){{2,}}"), "lead_timestamps"),
        (bare.rlike(copyright_end), "copyright_tail"),
        (F.length(body) < min_chars, "too_short"),
        *[((F.length(body) < short) & body.rlike(p), name) for p, name in residue],
    ]
    reason = ordered_rules(rules, "")
    return F.struct(F.when(reason == "", body).alias("sentence"), F.nullif(reason, F.lit("")).alias("reason"))


def clean_posts(
    posts: DataFrame, text: str, role: str | None = None, similarity: str | None = None, threshold: float = 0.40, keep: str | None = None, most_latin: float = 0.55, own_script: str = "[一-鿿]", least_own: int = 3
) -> DataFrame:
    """posts with cleaned, the text without hashtags, and drop_reason: hashtag_only for any post; for
    those in the role ``context`` (all, where no column says) also mostly_latin, unless the pattern
    keep occurs, and low_similarity, where a missing one counts 1."""
    c = F.coalesce(F.col(text), F.lit(""))
    tagged = c.rlike(r"(?U)#\S+")
    cleaned = F.when(tagged, strip(F.regexp_replace(c, r"(?U)#\S+", ""))).otherwise(c)
    solid = F.length(F.regexp_replace(cleaned, r"(?U)\s", ""))
    latin = F.try_divide(F.regexp_count(cleaned, F.lit("[A-Za-z]")), solid)
    own = F.regexp_count(cleaned, F.lit(own_script))
    spared = cleaned.rlike(keep) if keep else F.lit(False)
    context = F.lower(F.col(role)) == "context" if role else F.lit(True)
    sim = F.coalesce(F.col(similarity), F.lit(1.0)) if similarity else F.lit(1.0)
    reason = F.when(c.rlike(r"(?U)^#\S+$"), "hashtag_only").when(context & (latin > most_latin) & (own < least_own) & ~spared, "mostly_latin").when(context & (sim < threshold), "low_similarity")
    return posts.withColumns({"cleaned": cleaned, "drop_reason": reason})


def procedural(c: Column, prefixes: Sequence[str], keep_hints: Sequence[str], markers: Sequence[str]) -> Column:
    """A moderator's procedural line: its prefix, no hint to keep it, and a marker."""
    start = F.lit(False)
    for p in prefixes:
        start = start | c.startswith(p)
    return start & ~any_term(c, keep_hints) & any_term(c, markers)


def debate_action(c: Column, is_procedural: Column, filler: str, stance: str, min_chars: int = 15) -> Column:
    return ordered_rules([(is_procedural, "DROP_PROCEDURAL"), (F.length(c) >= min_chars, "KEEP"), (c.rlike(filler), "DROP_FILLER"), (c.rlike(stance), "KEEP_AUTO")], "KEEP")


def review_count(rows: DataFrame, status: str = "final_status") -> DataFrame:
    return rows.agg(F.count_if(F.upper(status) == "REVIEW").alias("n_review"))


def facets(rows: DataFrame, chosen: dict[str, Sequence[str]]) -> DataFrame:
    """Rows whose columns hold one of the chosen values; a column with none chosen does not filter."""
    for column, values in chosen.items():
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return rows


def status_counters(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: how many rows there are, and how many fulfil each condition, in one pass."""
    return rows.agg(F.count("*").alias("n"), *[F.count_if(cond).alias(name) for name, cond in flags.items()])
