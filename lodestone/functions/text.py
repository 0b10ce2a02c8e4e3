"""Column functions for text: tokens, labels, cleaning, costs. Everything but Unicode folding runs in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import fixed


def tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric runs without the index's stop words; numbers stay, nothing is stemmed."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(fixed.TOKEN), 0), lambda t: ~t.isin(fixed.INDEX_STOP_WORDS))


def keywords(question: Column) -> Column:
    """The distinct words of a question that carry content."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(question), F.lit(fixed.TOKEN), 0), lambda t: ~t.isin(fixed.KEYWORD_STOP_WORDS)))


def token_count(text: Column) -> Column:
    """The offline token counter: alphanumeric runs and single other marks."""
    return F.regexp_count(F.lower(text), F.lit(fixed.COUNTED_TOKEN))


def words(text: Column) -> Column:
    """The pieces between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def folded_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z0-9]+", "")


def slug(text: Column) -> Column:
    """Lower-case words joined by dashes, 60 characters at most; ``part`` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(bare, 1, 60), F.lit("")), F.lit("part"))


def has_letters_or_digits(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def instrument_key(text: Column) -> Column:
    """(kind, number, year) of the first legal instrument named, or null."""
    part = lambda i: F.regexp_extract(text, fixed.INSTRUMENT_KEY, i)
    found = F.struct(F.lower(F.regexp_replace(part(1), r"[\s-]+", "")).alias("kind"), part(2).try_cast("int").alias("number"), part(3).try_cast("int").alias("year"))
    return F.when(text.rlike(fixed.INSTRUMENT_KEY), found)


def without_hidden(text: Column) -> Column:
    """The text without characters that can hide content from a reader."""
    return F.regexp_replace(text, fixed.HIDDEN, "")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def plain(text: Column) -> Column:
    """Lower case with single spaces, for containment tests."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility folding; the JVM has no such SQL function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def folded(text: Column) -> Column:
    """``nfkc`` of the texts that it can change. ASCII texts, which it can't, go to Python as nulls: a UDF runs on every row, whatever CASE surrounds it."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def corpus_normalised(text: Column) -> Column:
    """Folded, zero-width marks deleted, every space-like run as one space, trimmed."""
    bare = F.regexp_replace(folded(text), r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+", " "))


def tidy_lines(text: Column) -> Column:
    """The steps of ``workspace_normalised`` after folding: line structure stays, at most one blank line."""
    out = F.regexp_replace(text, r"[\x{200B}\x{FEFF}\x{AD}]", "")
    out = F.regexp_replace(out, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]+", " ")
    return stripped(F.regexp_replace(out, "\n{3,}", "\n\n"))


def workspace_normalised(text: Column) -> Column:
    return tidy_lines(folded(text))


def json_object(raw: Column, schema: str) -> Column:
    """The outermost {...} of a model's reply, as a struct; null if there is none that parses."""
    bare = F.regexp_replace(F.trim(raw), r"(?m)^```(?:json)?\s*|\s*```$", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(found != "", F.from_json(found, schema, {"mode": "PERMISSIVE"}))


def probability(logit: Column) -> Column:
    return F.when(logit.isNotNull(), 1 / (1 + F.exp(-logit)))


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """The price of a call; models without a listed price get the default one."""
    default_in, default_out = fixed.DEFAULT_PRICE
    return (tokens_in * F.coalesce(price_in, F.lit(default_in)) + tokens_out * F.coalesce(price_out, F.lit(default_out))) / 1_000_000


def article_header(label: Column, number: Column, title: Column, section: Column) -> Column:
    """``label - Article n``, then ``: title`` or else `` (section)`` where there is one."""
    base = F.concat(label, F.lit(" - Article "), number.cast("string"))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(some(title), F.concat(base, F.lit(": "), title)).when(some(section), F.concat(base, F.lit(" ("), section, F.lit(")"))).otherwise(base)


def heading_number(raw: Column) -> Column:
    """A plain integer only; nested and Roman numbers give null."""
    return F.when(raw.rlike(r"^\d+$"), raw.try_cast("int"))


def chunk_id(law: Column, part: Column, number: Column, seq: Column, text: Column) -> Column:
    return F.concat(law, F.lit(":"), part, F.lit(":a"), number.cast("string"), F.lit(":"), seq.cast("string"), F.lit(":"), F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 10))


def point_id(chunk: Column) -> Column:
    """The first 63 bits of the id's SHA-256 as a non-negative long."""
    head = F.conv(F.substring(F.sha2(F.encode(chunk, "UTF-8"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.floor(head / 2).cast("long")


def citation_key(law: Column, part: Column, number: Column) -> Column:
    return F.concat(law, F.lit("#"), part, F.lit("#art"), number.cast("string"))


def display_citation(label: Column, unit: Column, number: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit(", "), unit, F.lit(" "), number.cast("string"), F.lit("]"))


def chunk_heading(label: Column, unit: Column, number: Column, title: Column, seq: Column, seq_total: Column) -> Column:
    base = F.concat(label, F.lit(" — "), unit, F.lit(" "), number.cast("string"), F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(": "), title)).otherwise(""))
    return F.when(seq_total > 1, F.concat(base, F.lit(" ("), (seq + 1).cast("string"), F.lit("/"), seq_total.cast("string"), F.lit(")"))).otherwise(base)


def split_after(text: Column, marks: str) -> Column:
    """Sentences: cut at the white space after any of ``marks``; blank pieces are dropped."""
    return F.filter(F.split(text, rf"(?<={marks})\s+"), lambda s: F.trim(s) != "")


def clauses(text: Column) -> Column:
    """Cut before ``1. ``, ``a. ``, ``(a) `` and ``(1) `` at the start or after white space."""
    return F.filter(F.split(text, fixed.CLAUSE_SPLIT_JAVA), lambda s: F.trim(s) != "")
