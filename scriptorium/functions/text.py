"""Text analysis and cleaning as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of letters, digits and "_" of any script; Java's \W knows ASCII only.
NON_WORD = r"[^\p{L}\p{N}_]+"
MOST_TERM_CHARS = 25


def tokenize(text: Column) -> Column:
    """Array of the pieces between non-word characters; an edge gives an empty piece."""
    return F.split(text, NON_WORD)


@dataclass(frozen=True)
class Analyzer:
    """Lower case, drops empty tokens, stop words and terms of more than 25 characters, and stems if asked to."""

    stop_words: frozenset[str] = field(default_factory=frozenset)
    stem: bool = False
    most_chars: int = MOST_TERM_CHARS

    def _keep(self, term: Column) -> Column:
        keep = (term != "") & (F.length(term) <= self.most_chars)
        return keep & ~term.isin(*sorted(self.stop_words)) if self.stop_words else keep

    def terms(self, text: Column) -> Column:
        """Array of terms in text order."""
        found = F.filter(F.transform(tokenize(text), F.lower), self._keep)
        return stems(found) if self.stem else found

    def terms_with_tokens(self, text: Column) -> Column:
        """Array of (term, token), the token as it stands in the text."""
        pairs = F.transform(tokenize(text), lambda t: F.struct(F.lower(t).alias("term"), t.alias("token")))
        found = F.filter(pairs, lambda p: self._keep(p["term"]))
        if not self.stem:
            return found
        stemmed = stems(F.transform(found, lambda p: p["term"]))
        return F.zip_with(stemmed, found, lambda s, p: F.struct(s.alias("term"), p["token"].alias("token")))

    def term(self, word: str) -> str | None:
        """The term of one query word, or None if it is dropped."""
        from .porter import stem

        low = word.lower()
        if not low or low in self.stop_words or len(low) > self.most_chars:
            return None
        return stem(low) if self.stem else low


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(terms: pd.Series) -> pd.Series:
    from .porter import stem

    memo: dict[str, str] = {}

    def of(t: str) -> str:
        if t not in memo:
            memo[t] = stem(t)
        return memo[t]

    return terms.map(lambda x: [of(t) for t in x], na_action="ignore")


def valid_term(term: Column) -> Column:
    """Letters only."""
    return term.rlike(r"^\p{L}+$")


def value_term(field_name: str, value: Column) -> Column:
    """The term of a field's value: field:words_joined, case kept. Pieces at the edges stay, as empty ones."""
    return F.concat(F.lit(f"{field_name}:"), F.regexp_replace(value, NON_WORD, "_"))


def document_text(*fields: Column) -> Column:
    """Fields joined by spaces; array fields are joined first; null fields count as empty ones."""
    return F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields])


def sentences(text: Column) -> Column:
    """Pieces between full stops, not stripped, empty ones dropped."""
    return F.filter(F.split(text, r"\."), lambda s: s != "")


def sentence_texts(text: Column) -> Column:
    """Sentences with their stops: cut where white space follows a full stop, an exclamation mark or a question mark."""
    return F.filter(F.split(F.regexp_replace(strip(text), r"([.!?])\s+", "$1\x01"), "\x01"), lambda s: s != "")


_SPACE = r"(?U)\s+"
_MARKS = r"[!|\"£$%^&*()_+=}{\[\]~:;><.,/']"


def clean_body(text: Column) -> Column:
    """Words with ASCII characters only. Words with "http" or "@" stay (less "mailto:"); others lose marks and digits, and go
    if two characters or fewer are left. Words are joined with a space before each, then "- " and " -" are deleted."""

    def word(w: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(w, _MARKS, ""), "[0-9]", "")
        verbatim = w.contains("http") | w.contains("@")
        return F.when(verbatim, F.regexp_replace(w, "mailto:", "")).when(F.length(bare) > 2, bare)

    ascii_only = F.transform(F.split(text, _SPACE), lambda w: F.regexp_replace(w, r"[^\x00-\x7F]", ""))
    words = F.filter(F.transform(ascii_only, word), lambda w: w.isNotNull() & (w != ""))
    return F.regexp_replace(F.array_join(F.transform(words, lambda w: F.concat(F.lit(" "), w)), ""), "- | -", "")


def without_parentheses(text: Column) -> Column:
    """Balanced groups in parentheses deleted, however deep; what has no partner stays."""
    innermost = r"\([^()]*\)"
    text = F.regexp_replace(F.regexp_replace(text, innermost, ""), innermost, "")
    # deeper ones are rare: as many rounds as there are openings left are enough
    deeper = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - F.length(F.replace(text, F.lit("("), F.lit(""))))), text, lambda t, _: F.regexp_replace(t, innermost, ""))
    return F.when(text.rlike(innermost), deeper).otherwise(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def authors(text: Column) -> Column:
    """Names between commas and " and ", parentheses deleted."""
    return F.filter(F.transform(F.split(without_parentheses(text), ",| and "), strip), lambda x: x != "")


def codes_in_parentheses(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\((\S*)\)"), F.lit(1))


def split_codes(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda x: x != "")


def map_codes(docs: DataFrame, id_column: str, codes: Column, lookup: DataFrame, distinct: bool = True, strict: bool = True) -> DataFrame:
    """(id, names): for each row the names of its codes by lookup (code, name), sorted (none if it has no codes, also where rows
    share an id); unknown codes are an error if strict, and left out otherwise.

    The lookup is joined plainly: Spark broadcasts it when its size allows."""
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), id_column, codes.alias("__codes"))
    exploded = rows.select("__row", id_column, F.explode_outer("__codes").alias("code"))
    if strict and (unknown := exploded.where("code is not null").join(lookup, "code", "left_anti").select("code").limit(1).collect()):
        raise KeyError(f"unknown code {unknown[0].code}")
    collect = F.collect_set if distinct else F.collect_list
    return exploded.join(lookup, "code", "left").groupBy("__row", id_column).agg(F.sort_array(collect("name")).alias("names")).drop("__row")


def distinct_values(values: Column) -> Column:
    return F.sort_array(F.array_distinct(values))


def metadata_value(text: Column, label: str) -> Column:
    """A scraped field without its label, line ends as spaces, less its first and last character."""
    bare = F.regexp_replace(F.regexp_replace(text, label, ""), "\n", " ")
    return F.substring(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0)))


def paper_id(day: Column, number: Column) -> Column:
    """yyMM.nnnnn, or with more digits where the number has more."""
    digits = number.cast("string")
    return F.concat(F.date_format(day, "yyMM"), F.lit("."), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits))


def id_year_month(paper: Column) -> tuple[Column, Column]:
    """Year and month (two digits each) of an id as above, with or without "arXiv:" before it."""
    bare = F.regexp_replace(paper, r"^[A-Za-z]+:", "")
    return F.substring(bare, 1, 2).cast("int"), F.substring(bare, 3, 2).cast("int")


def age_in_years(year: Column, month: Column, now_year: int, now_month: int) -> Column:
    """Months since then over twelve, halves rounded up; year counts from 2000."""
    return F.floor((F.lit(12 * now_year + now_month) - (12 * (year + 2000) + month)) / 12 + 0.5).cast("long")


def ngrams(terms: Column, n: int) -> Column:
    """Array of the n-grams of an array of terms, joined by spaces."""
    starts = F.when(F.size(terms) >= n, F.sequence(F.lit(1), F.size(terms) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(terms, i, n), " "))


def highlight(text: Column, prefix: str) -> Column:
    """prefix<b>rest</b>"""
    return F.concat(F.substring(text, 1, len(prefix)), F.lit("<b>"), F.substring(text, F.lit(len(prefix) + 1), F.length(text)), F.lit("</b>"))


def total_pages(total: Column, per_page: int) -> Column:
    return F.ceil(total / per_page)


def page_offset(page: Column, per_page: int) -> Column:
    return (page - 1) * per_page


def is_true(text: Column) -> Column:
    return F.lower(text).isin("true", "t")


def value_counts(rows: DataFrame, values: Callable[[], Column]) -> DataFrame:
    """(value, count) over the values of array columns."""
    return rows.select(F.explode(values()).alias("value")).groupBy("value").agg(F.count("*").alias("count"))
