"""Text expressions: normal forms, tokens, titles, excerpts, citation markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.scalars import let

# White space as Unicode text editors see it (NBSP included); word characters are letters, digits
# and the underscore. Explicit classes match much faster than the (?U) shorthands.
SPACE_CLASS = r"\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u001c-\u001f"
SPACE = rf"[{SPACE_CLASS}]+"
SPACE_CHARS = (" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
               + "\u2028\u2029\u202f\u205f\u3000")
WORD = r"[\p{L}\p{N}_]+"
WORD_NO_UNDERSCORE = r"[\p{L}\p{N}]+"

# Words that carry no weight in the query/title overlap.
TITLE_STOP_WORDS = (
    "and", "are", "does", "for", "from", "how", "into", "that", "the", "this", "what", "when",
    "where", "which", "who", "why", "with",
)

# Fixed value: numbered citation markers such as [1], [1, 2] or [1; 2].
CITATION_GROUP = r"\[((?:\s*\d+\s*)(?:(?:,|;)\s*\d+\s*)*)\]"


def strip(text: Column) -> Column:
    """Trim white space of every kind at both ends (cheaper than a regular expression)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def normalize_inline(text: Column) -> Column:
    """Collapse every whitespace run (NBSP included) to one space and trim."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_multiline(text: Column) -> Column:
    """Normalize each line, keep at most one blank line in a row, trim blank ends."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), normalize_inline)
    joined = F.array_join(lines, "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def non_space_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def tokens(text: Column) -> Column:
    """All word tokens in order, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def token_set(text: Column, minimum: int = 3) -> Column:
    """Distinct lower-case word tokens of at least ``minimum`` characters."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= minimum))


def token_coverage(needle: Column, haystack: Column) -> Column:
    """Share of the needle's token set that occurs in the haystack; null without needle tokens."""
    wanted = token_set(needle)
    shared = F.size(F.array_intersect(wanted, token_set(haystack)))
    return F.when(F.size(wanted) > 0, shared / F.size(wanted))


def query_title_overlap(query: Column, title: Column) -> Column:
    """Share of the query's content words (stop words and words under 3 letters removed) in the title."""
    words = lambda c: F.array_distinct(
        F.regexp_extract_all(F.lower(c), F.lit(WORD_NO_UNDERSCORE), F.lit(0)))
    stop = F.array(*[F.lit(w) for w in TITLE_STOP_WORDS])
    wanted = F.array_except(F.filter(words(query), lambda t: F.length(t) > 2), stop)
    shared = F.size(F.array_intersect(wanted, words(title)))
    return F.when(F.size(wanted) > 0, shared / F.size(wanted)).otherwise(F.lit(0.0))


def display_title(version_title: Column, identity_title: Column, url: Column) -> Column:
    """Version title, else identity title, else the decoded last path segment of the URL."""
    blank_to_null = lambda c: F.when(F.trim(c) != "", c)
    title = F.trim(F.coalesce(blank_to_null(version_title), blank_to_null(identity_title), F.lit("")))
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    segment = F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)
    base = F.trim(F.try_url_decode(segment))
    from_url = F.when(base != "", base).otherwise(url)
    return F.when((title == "") | title.startswith("http://") | title.startswith("https://"),
                  from_url).otherwise(title)


def bounded_excerpt(text: Column, query: Column, maximum: int = 620) -> Column:
    """``struct(excerpt, truncated)``: a window of ``maximum`` characters that starts a quarter
    window before the first query token found, with an ellipsis on each cut side."""
    words = F.filter(F.split(normalize_inline(F.lower(query)), " "), lambda t: F.length(t) > 2)

    def excerpt(compact: Column) -> Column:
        first = let(F.lower(compact), lambda low: F.array_min(F.filter(
            F.transform(words, lambda t: F.instr(low, t) - 1), lambda p: p >= 0)))
        return let(F.greatest(F.lit(0), F.coalesce(first, F.lit(0)) - F.lit(maximum // 4)),
                   lambda start: window(compact, start))

    def window(compact: Column, start: Column) -> Column:
        cut = F.substr(compact, start + 1, F.lit(maximum))
        left = F.when(start > 0, F.concat(F.lit("…"), F.ltrim(cut))).otherwise(cut)
        return F.when(start + maximum < F.length(compact),
                      F.concat(F.rtrim(left), F.lit("…"))).otherwise(left)

    return let(normalize_inline(text), lambda c: F.struct(
        F.when(F.length(c) > maximum, excerpt(c)).otherwise(c).alias("excerpt"),
        (F.length(c) > maximum).alias("truncated")))


def citation_numbers(answer: Column) -> Column:
    """Distinct source numbers named by the answer's bracketed markers, ascending."""
    groups = F.regexp_extract_all(answer, F.lit(CITATION_GROUP), F.lit(1))
    digits = F.regexp_extract_all(F.array_join(groups, " "), F.lit(r"\d+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(digits, lambda d: d.cast("int"))))


def verified_quote(text: Column, quote: Column, cap: int = 500) -> Column:
    """The whitespace-normalized quote (at most ``cap`` characters) if the text contains it
    regardless of case, else null."""
    q = normalize_inline(quote)
    found = (q != "") & F.contains(F.lower(normalize_inline(text)), F.lower(q))
    return F.when(found, F.substring(q, 1, cap))


def shorten(text: Column, width: int = 76) -> Column:
    """Normalized text, cut at a word boundary and ended by ``…`` so that it fits ``width``."""
    compact = normalize_inline(text)
    head = F.rtrim(F.regexp_extract(compact, rf"^(.{{0,{width - 1}}})(?=\s|$)", 1))
    return F.when(F.length(compact) <= width, compact).otherwise(F.concat(head, F.lit("…")))


def bounded_text(text: Column, maximum: int) -> Column:
    """``struct(text, truncated)``: the first ``maximum`` characters and whether any were cut."""
    return F.struct(F.substring(text, 1, maximum).alias("text"),
                    (F.length(text) > maximum).alias("truncated"))


def embedding_input(title: Column, heading: Column, body: Column) -> Column:
    """Labelled title, labelled heading and body on separate lines; blank parts are left out."""
    labelled = lambda label, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "",
                                       F.concat(F.lit(label), F.trim(c)))
    return F.concat_ws("\n", labelled("Document title: ", title),
                       labelled("Section heading: ", heading), body)
