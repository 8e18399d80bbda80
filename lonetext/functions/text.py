"""Column functions that turn wiki pages into plain labelled texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The patterns and the category order that define the corpus.
# (?d) makes '.' stop at line feeds only.
REDIRECT = r"(?id)#redirect \[\[.*?\]\]"
CATEGORY = r"(?i)\[\[Categoria:([^\]]*)\]\]"
DATE = r"(?i)\{\{data\|([^\}]*)\}\}"
SOURCE = r"(?i)\{\{Fonte\|[^\}]*\}\}"
PRIORITY = ("Política", "Economia", "Saúde", "Ciência e tecnologia", "Cultura")

BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"

# Markup and what it leaves behind, in the order applied. Templates and tables go innermost first; their content may
# hold single braces and bars; possessive repeats keep a match linear. A tag starts with a letter, so that "3 < 5" stays.
NESTED = (r"\{\{[^{}]*+(?:[{}][^{}]++)*+\}\}", r"\{\|[^{|]*+(?:(?:\{[^{|]|\|++[^{|}])[^{|]*+)*+\|++\}")
OPENING = (r"\{\{", r"\{\|")
MARKUP_BEFORE = ((r"(?s)<!--.*?-->", ""), (r"(?i)<ref[^>]*/>", ""), (r"(?is)<ref[^>]*>.*?</ref>", ""),
                 (r"</?[A-Za-z][^<>]*>", ""))
MARKUP_AFTER = ((r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), (r"\[\[([^\[\]]*)\]\]", "$1"),
                (r"\[https?://[^ \]]+ ([^\]]*)\]", "$1"), (r"\[https?://[^ \]]+\]", ""), (r"'{2,}", ""),
                (r"(?m)^=+[ \t]*([^=\n]*?)[ \t]*=+[ \t]*$", "$1"))
# The named references that pages use; the ampersand comes last.
ENTITIES = (("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&quot;", '"'), ("&apos;", "'"),
            ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def is_redirect(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(REDIRECT), F.lit(False))


def categories(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(CATEGORY), 1)


def without(text: str | Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def computed_once(value: Column) -> Column:
    """`value` behind a one-row generator: a filter on it does not make Catalyst compute it a second time."""
    return F.explode_outer(F.array(value))


def main_category(found: Column) -> Column:
    """The first name of the priority list that occurs in any category; NULL if none does."""
    def first_of(cats: Column) -> Column:
        def occurs(name: str) -> Column:
            return F.exists(cats, lambda c: F.lower(c).contains(name.lower()))

        return F.coalesce(*[F.when(occurs(p), F.lit(p)) for p in PRIORITY])

    # The lambda binds `found`, so that the pattern is matched once and not per name.
    return F.get(F.transform(F.array(found), first_of), F.lit(0))


def dates(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE), 1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def _without(pattern: str, opening: str) -> Callable[[Column], Column]:
    """Remove innermost matches until none is left: one pass per level of nesting, whatever the number of matches.

    There are no more levels than openings; once a pass changes nothing, the steps left over do nothing.
    """
    def once(state: Column, _: Column) -> Column:
        def shorter(t: Column) -> Column:
            return F.struct(t.alias("text"), (F.length(t) < F.length(state["text"])).alias("open"))

        # The lambda binds the replaced text, so that the pattern is matched once a pass.
        replaced = F.transform(F.array(F.regexp_replace(state["text"], pattern, "")), shorter)
        return F.when(state["open"], F.get(replaced, F.lit(0))).otherwise(state)

    def removed(text: Column) -> Column:
        levels = F.regexp_count(text, F.lit(opening))
        start = F.struct(text.alias("text"), F.lit(True).alias("open"))
        return F.when(levels == 0, text).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), start, once, lambda s: s["text"]))

    return removed


def strip_markup(text: Column) -> Column:
    """Wiki markup to plain text by a chain of replacements: an approximation of a full markup parser."""
    text = reduce(lambda t, step: F.regexp_replace(t, *step), MARKUP_BEFORE, text)
    for pattern, opening in zip(NESTED, OPENING):
        # The lambda binds the text so far, so that it is computed once.
        text = F.get(F.transform(F.array(text), _without(pattern, opening)), F.lit(0))
    text = reduce(lambda t, step: F.regexp_replace(t, *step), MARKUP_AFTER, text)
    return stripped(reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text))


def not_empty(text: str) -> Column:
    return F.col(text).rlike(f"(?s)[^{BLANK[1:-1]}]")


def wiki_articles(pages: DataFrame, *keep: str) -> DataFrame:
    """Pages (ns, text) to articles (text, label): cheap row filters first, the markup chain last."""
    body = reduce(without, (CATEGORY, SOURCE, DATE), F.col("text"))
    return (pages.filter((F.col("ns") == 0) & ~is_redirect("text"))
            .select(*keep, "text", computed_once(main_category(categories("text"))).alias("label"))
            .filter(F.col("label").isNotNull())
            .select(*keep, computed_once(strip_markup(body)).alias("text"), "label").filter(not_empty("text")))


def text_and_label(df: DataFrame, *keys: str) -> tuple[str, str]:
    """Names of the text and label columns: by name, else the first and the last column besides the keys."""
    names = [c for c in df.columns if c not in keys]
    return ("text" if "text" in names else names[0]), ("label" if "label" in names else names[-1])


def as_text(df: DataFrame, column: str) -> Column:
    """A text column as a string; list values are joined with blanks."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        words = F.transform(column, lambda w: F.coalesce(w.cast("string"), F.lit("None")))
        return F.array_join(words, " ")
    return F.col(column).cast("string")


def as_corpus(df: DataFrame, *keep: str) -> DataFrame:
    """(keep..., text, label) from any labelled table; rows without text are dropped."""
    text, label = text_and_label(df, *keep)
    return (df.select(*keep, as_text(df, text).alias("text"), F.col(label).alias("label"))
            .filter(F.col("text").isNotNull()))
