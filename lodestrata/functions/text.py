"""String functions, as Column compositions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import CHARACTERS, DEFAULT, DEFINITION_PARTS, REGISTER_WORDS, Profile
from .formulas import fixed


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row where plain nesting would compute it wherever it is named, as inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def trim_all(c: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def clean_text(c: Column, profile: Profile = DEFAULT) -> Column:
    """Page text without watermarks, with plain characters, spaces and line breaks, and without brackets left empty."""
    for pattern in profile.watermarks:
        c = F.regexp_replace(c, f"(?imU){pattern}", "")
    single = {k: v for k, v in CHARACTERS.items() if len(v) == 1}
    c = F.translate(c, "".join(single), "".join(single.values()))
    for k, v in CHARACTERS.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    for pattern, name in profile.variants:
        c = F.regexp_replace(c, f"(?U){pattern}", name)
    c = F.replace(c, F.lit("∆"), F.lit("Delta"))
    for pattern, new in ((r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"(?U)\(\s*\)", ""), (r"(?U)\[\s*\]", ""), (r"(?U)\(\s*\.\s*\)", "")):
        c = F.regexp_replace(c, pattern, new)
    return trim_all(c)


def normalize_label(c: Column, profile: Profile = DEFAULT) -> Column:
    """A heading's key: lower case, the product's name in one spelling, single blanks, no dots around it."""
    pattern, name = profile.label_variant
    c = F.regexp_replace(F.lower(trim_all(c)), f"(?U){pattern}", name)
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^[. ]+|[. ]+\z", "")


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))


def section_number(title: Column) -> Column:
    """The number at a title's beginning, or an empty string."""
    return F.regexp_extract(trim_all(title), r"^(\d+(?:\.\d+)*)\s*(.*)", 1)


def bare_title(title: Column) -> Column:
    t = trim_all(title)
    return F.when(t.rlike(r"^\d"), trim_all(F.regexp_extract(t, r"^(\d+(?:\.\d+)*)\s*(.*)", 2))).otherwise(t)


def section_path(number: Column) -> Column:
    """"6.10.4" as [6, 6.10, 6.10.4]."""
    parts = F.split(number, r"\.")
    path = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return F.when(number == "", F.array().cast("array<string>")).otherwise(path)


def section_label(path: Column, title: Column) -> Column:
    last = F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit(""))
    return F.when((last != "") & (title != ""), F.concat_ws(" ", last, title)).otherwise(title)


def context_prefix(version: Column, label: Column, page: Column, product: str = DEFAULT.product) -> Column:
    """The line that opens a chunk's text; a null label is front matter."""
    return F.concat(F.lit(f"[{product} "), version, F.lit(" | "), F.coalesce(label, F.lit("(front matter)")), F.lit(" | Page "), page.cast("string"), F.lit("]\n"))


def file_version(name: Column) -> Column:
    """B51 in a file's name is 5.1."""
    p = r"(?i)B(\d)(\d+)"
    return F.when(name.rlike(p), F.concat(F.regexp_extract(name, p, 1), F.lit("."), F.regexp_extract(name, p, 2))).otherwise("unknown")


def short_source(source: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(source, "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    found = F.upper(F.regexp_extract(source, r"(?i)B\d+", 0))
    return F.when(found != "", found).otherwise(stem)


def versions_named(query: Column, profile: Profile = DEFAULT) -> Column:
    """The versions that a query names, in the profile's order."""
    named = F.array(*[F.when(query.rlike(f"(?i){p}"), F.lit(v)) for v, p in profile.versions])
    return F.array_compact(named)


def target_versions(query: Column, default: Column | str, profile: Profile = DEFAULT) -> Column:
    """Those named, else the default; an empty array (no filter) where the default is empty or "all"."""
    d = F.lit(default) if isinstance(default, str) else default
    named = versions_named(query, profile)
    return F.when(F.size(named) > 0, named).when(d.isNull() | d.isin("", "all"), F.array().cast("array<string>")).otherwise(F.array(d))


def preview(c: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def metric_cell(c: Column) -> Column:
    """Four decimals; null and NaN as a dash."""
    return F.when(c.isNull() | F.isnan(c), F.lit("—")).otherwise(fixed(c, 4))


def is_register_text(c: Column) -> Column:
    words = reduce(lambda a, b: a | b, [F.lower(c).contains(w) for w in REGISTER_WORDS])
    return c.rlike(r"\[\d+(?::\d+)?\]") & words


def is_definition_page(title: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(title).contains(w) for w in DEFINITION_PARTS])


def block_kind(text: Column, title: Column) -> Column:
    """definition, register or text, for a text block of a section."""
    return F.when(F.coalesce(is_definition_page(title), F.lit(False)), "definition").when(is_register_text(text), "register").otherwise("text")


# What captions and definitions look like.
TABLE_CAPTION = r"(?i)Table\s+\d+[\s—\-]+[^\n]{5,80}"
FIGURE_CAPTION = r"(?i)Figure\s+\d+[\s—\-]+[^\n]{3,120}"


def table_caption(c: Column) -> Column:
    return trim_all(F.regexp_extract(c, TABLE_CAPTION, 0))


def figure_caption(c: Column) -> Column:
    return trim_all(F.regexp_extract(c, FIGURE_CAPTION, 0))


ABBREVIATION = r"(?m)^([A-Z][A-Z0-9_/\-]{1,20})\s*[:\-–—]\s*(.{10,200})$"
NUMBERED_TERM = r"(?m)^\d+(?:\.\d+)+\s+([A-Za-z][^\n]{3,60})\n(.{20,500})"
MEANS = r"(?i)([A-Z][A-Za-z0-9_\-\s]{2,40}?)\s+(?:means|is defined as|refers to)\s+(.{10,200})"
ABBREVIATED = r"(?i)([A-Z][A-Za-z0-9_\-\s]{2,40}?)\s+\(abbreviated\s+as\s+([A-Z][A-Z0-9_\-]{1,15})\)"


def _pairs(c: Column, pattern: str) -> Column:
    term, meaning = (F.regexp_extract_all(c, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.transform(F.arrays_zip(term.alias("t"), meaning.alias("d")), lambda p: F.struct(trim_all(p["t"]).alias("term"), trim_all(p["d"]).alias("definition")))


def definitions(c: Column) -> Column:
    """(term, definition) pairs: abbreviations, or where there are none, numbered terms."""
    short = _pairs(c, ABBREVIATION)
    numbered = _pairs(c, NUMBERED_TERM)
    return F.when(F.size(short) > 0, short).otherwise(numbered)


def inline_definitions(c: Column) -> Column:
    """(term, definition) pairs of running text, the first of each term whatever its case."""
    # the patterns try every place of a text: they are tried only where it holds their words, and the pairs are found once
    low = F.lower(c)
    none = F.array().cast("array<struct<term:string,definition:string>>")
    means = F.when(low.contains("means") | low.contains("is defined as") | low.contains("refers to"), _pairs(c, MEANS)).otherwise(none)
    short = F.when(low.contains("abbreviated"), _pairs(c, ABBREVIATED)).otherwise(none)

    def first_ones(both: Column) -> Column:
        return let(F.transform(both, lambda p: F.lower(p["term"])), lambda keys: F.filter(both, lambda p, i: F.array_position(keys, F.lower(p["term"])) == i + 1))

    return F.when(c.isNotNull(), let(F.concat(means, short), first_ones))
