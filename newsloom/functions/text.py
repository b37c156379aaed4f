"""Text cleaning and scoring as column expressions; all run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
TRACKING = ("ref", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
GERMAN_MONTHS = (
    ("Januar", "January"), ("Februar", "February"), ("März", "March"), ("Mai", "May"), ("Juni", "June"),
    ("Juli", "July"), ("Oktober", "October"), ("Dezember", "December"),
)
LANGUAGE_WORDS = {
    "de": ("der", "die", "und", "das", "nicht", "mit"), "en": ("the", "of", "and", "to", "in", "is"),
    "es": ("el", "los", "que", "una", "por", "con"), "fr": ("le", "les", "des", "est", "une", "pour"),
}


def normalize_url(url: Column, tracking: Sequence[str] = TRACKING) -> Column:
    """Lower scheme and host, without default port, fragment, tracking parameters and closing slash; parameters in order."""
    part = lambda k: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]*)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?", k)
    scheme, host, port, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4), part(5)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*tracking)))
    clean_path = F.regexp_replace(F.regexp_replace(path, r"/\./", "/"), r"/+$", "")
    out = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), clean_path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(scheme == "", url).otherwise(out)


def replace_all(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, in their order."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def collapse_whitespace(text: Column) -> Column:
    """One kind of line end, at most one empty line in a row, single blanks, no blanks at the ends of lines."""
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"\A[ \n]+|[ \n]+\z", "")


def strip_html(html: Column) -> Column:
    """Text of HTML: without scripts, styles, comments and tags; common entities decoded."""
    bare = F.regexp_replace(html, r"(?is)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->", " ")
    return collapse_whitespace(replace_all(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), ENTITIES))


def strip_links(text: Column) -> Column:
    """Markdown images vanish, links leave their text."""
    return F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]*)\]\([^)]*\)", "$1")


def remove_control(text: Column) -> Column:
    """Without control and format characters, line ends and tabs excepted."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")


def filter_lines(text: Column, *, skip: int = 0, exact: Sequence[str] = (), prefixes: Sequence[str] = (), contains: Sequence[str] = ()) -> Column:
    """Lines that no list names; the first ``skip`` are left out."""

    def bad(line: Column) -> Column:
        tests = [F.trim(line).isin(*exact)] if exact else []
        tests += [line.startswith(p) for p in prefixes] + [F.lower(line).contains(c.lower()) for c in contains]
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    lines = F.slice(F.split(text, "\n", -1), skip + 1, 1_000_000_000) if skip else F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda x: ~bad(x)), "\n")


def remove_boilerplate(text: Column, patterns: Sequence[str], aggressive: bool = False) -> Column:
    """Lines without boilerplate: aggressive takes a pattern anywhere, else only where no letter borders on it."""
    either = "|".join(patterns)
    rule = f"(?i)(?:{either})" if aggressive else f"(?i)(?:^|[^a-zA-Z])(?:{either})(?:[^a-zA-Z]|$)"
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(rule)), "\n")


def remove_blocks(text: Column, terms: Sequence[str]) -> Column:
    """Blocks between empty lines that hold none of the terms."""
    rule = "|".join(map(re.escape, terms))
    return F.array_join(F.filter(F.split(text, r"\n\s*\n", -1), lambda b: ~b.rlike(rule)), "\n\n")


def between_markers(text: Column, starts: Sequence[str], ends: Sequence[str]) -> Column:
    """What lies between the first start marker that occurs and the first end marker behind it; to the end without one; null without a start."""
    begin = F.coalesce(*(F.when(F.instr(text, s) > 0, F.instr(text, s) + len(s)) for s in starts))
    rest = F.substring(text, begin, F.length(text))
    end = F.coalesce(*(F.when(F.instr(rest, e) > 0, F.instr(rest, e) - 1) for e in ends), F.length(rest))
    return F.substring(rest, F.lit(1), end)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def detect_language(text: Column, indicator: dict[str, Sequence[str]], threshold: float, default: Column) -> tuple[Column, Column]:
    """Language and confidence by indicator words; the default, at 0.9, where none is sure enough."""
    own = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    counts = {lang: F.size(F.array_intersect(own, F.array(*map(F.lit, ws)))) for lang, ws in sorted(indicator.items())}
    best, total = F.greatest(*counts.values()), sum(counts.values(), F.lit(0))
    share = F.when(total > 0, best / total).otherwise(F.lit(0.0))
    lang = F.coalesce(*(F.when(c == best, F.lit(k)) for k, c in counts.items()))
    sure = share >= threshold
    return F.when(sure, lang).otherwise(default), F.when(sure, share).otherwise(F.lit(0.9))


def quality_score(text: Column, boilerplate_ratio: Column, floor: float = 0.5) -> Column:
    """0.3 for length, 0.4 for the share of letters (halved below the floor), 0.3 for little boilerplate."""
    chars = F.length(text)
    alpha = F.when(chars > 0, F.length(F.regexp_replace(text, r"\P{L}", "")) / chars).otherwise(F.lit(0.0))
    length = F.least(F.size(words(text)) / 100.0, F.lit(1.0))
    score = 0.3 * length + 0.4 * F.when(alpha < floor, alpha / 2).otherwise(alpha) + 0.3 * (1 - boilerplate_ratio)
    return F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 3)


def estimate_tokens(text: Column) -> Column:
    """The larger of characters by density and summed word costs, with a margin, rounded up."""
    chars = F.length(text)
    dense = F.length(F.regexp_replace(text, r"[\p{L}\s]", "")) / F.greatest(chars, F.lit(1))
    by_chars = chars / F.when(dense > 0.2, 3.0).when(dense > 0.1, 3.3).otherwise(3.6)
    cost = F.aggregate(words(text), F.lit(0.0), lambda a, w: a + F.when(F.length(w) <= 4, 1.0).when(F.length(w) <= 10, 1.5).otherwise(F.length(w) / 4.0))
    return F.ceil(F.greatest(by_chars, cost) * F.when(dense > 0.1, 1.12).otherwise(1.08))


def strip_heading(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^#+\s*", ""), r"\s+", " "))


def parse_date(text: Column, formats: Sequence[str]) -> Column:
    """The first format that fits, German months translated."""
    english = F.trim(text)
    for german, name in GERMAN_MONTHS:
        english = F.regexp_replace(english, rf"(?U)\b{german}\b", name)
    return F.coalesce(*(F.to_date(F.try_to_timestamp(english, F.lit(f))) for f in formats))


def date_to_iso(text: Column) -> Column:
    """ISO dates, months and years as they are; dd.MM.yyyy; quarters as their first day; null else."""
    quarter = F.concat(F.regexp_extract(text, r"(\d{4})", 1), F.lit("-"), F.lpad(((F.regexp_extract(text, r"Q([1-4])", 1).cast("int") - 1) * 3 + 1).cast("string"), 2, "0"), F.lit("-01"))
    return (
        F.when(text.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), text)
        .when(text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.concat_ws("-", F.substring_index(text, ".", -1), F.lpad(F.split(text, r"\.")[1], 2, "0"), F.lpad(F.split(text, r"\.")[0], 2, "0")))
        .when(text.rlike(r"^Q[1-4] \d{4}$|^\d{4}-Q[1-4]$"), quarter)
    )


def granularity(text: Column) -> Column:
    month = r"(?i)\b(jan|feb|mar|mär|apr|may|mai|jun|jul|aug|sep|oct|okt|nov|dec|dez)"
    return F.when(text.rlike(r"Q[1-4]"), "quarter").when(text.rlike(r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}"), "day").when(text.rlike(month) | text.rlike(r"^\d{4}-\d{2}$"), "month").when(text.rlike(r"^\d{4}$"), "year").otherwise("unknown")


def parse_number(text: Column) -> Column:
    """The number in a cell: a decimal comma counts as a point; other signs are dropped; null without digits."""
    bare = F.regexp_replace(F.replace(F.regexp_extract(text, r"^\s*([-+]?[0-9][0-9., ]*)", 1), F.lit(","), F.lit(".")), r"[^0-9.+-]", "")
    return bare.try_cast("double")


def unit_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"([A-Za-z%€]+)\s*$", 1), F.lit(""))


def fill_template(name: Column, template: str, slots: dict[str, Column]) -> Column:
    """The template with its slots; where one is null, the name and the other slots in order."""
    parts = re.split(r"\{(\w+)\}", template)
    filled = F.concat(*(slots[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2))
    other = F.array_join(F.array_compact(F.array(*(F.concat(F.lit(f"{k}="), v) for k, v in sorted(slots.items())))), ":")
    return F.coalesce(filled, F.concat(name, F.lit(":"), other))


def acronym(name: Column) -> Column:
    return F.upper(F.array_join(F.transform(words(name), lambda w: F.substring(w, 1, 1)), ""))


def clean_name(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), ".,;:!?'\"()[]-_/&", "")


def mask_numbered(text: Column, pattern: str, label: str) -> Column:
    """Each distinct match becomes a numbered placeholder, in the order of first occurrence."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    start = F.struct(text.alias("t"), F.lit(1).alias("n"))
    step = lambda a, m: F.struct(F.replace(a["t"], m, F.concat(F.lit(f"[{label}_"), a["n"].cast("string"), F.lit("]"))).alias("t"), (a["n"] + 1).alias("n"))
    return F.aggregate(found, start, step, lambda a: a["t"])


def occurrences(text: Column, needle: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")
