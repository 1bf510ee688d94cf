"""Readers and writers of statements: SPARQL TSV replies and N-Triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import decoded

_NT = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|".*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*$'
# Escapes of N-Triples and TSV for one character.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def is_safe_uri(uri: Column) -> Column:
    """Whether a URI can stand in angle brackets: it has no bracket, quote or blank."""
    return F.coalesce(~uri.rlike(r'[<>" ]'), F.lit(False))


def unescaped(text: Column) -> Column:
    """`\\n`, `\\"`, `\\u00e9`, `\\U0001F600` and so on as the characters they stand for; other text as it is."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\)"), F.lit(1))
    table = F.create_map(*(F.lit(x) for k, v in ESCAPES.items() for x in (k, v)))

    def one(part: Column) -> Column:
        code = F.conv(F.substring(part, 3, 8), 16, 10).cast("int")
        # characters beyond the first 65,536 are two halves in UTF-16
        halves = F.concat(_utf16(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), _utf16(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)))
        wide = F.when(code < 0x10000, F.decode(_utf16(code), "UTF-16BE")).otherwise(F.decode(halves, "UTF-16BE"))
        return F.when(part.rlike(r"^\\[uU][0-9A-Fa-f]{4}"), wide).when(part.startswith("\\") & (F.length(part) == 2), F.coalesce(F.try_element_at(table, F.substring(part, 2, 1)), part)).otherwise(part)

    return F.when(text.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _utf16(unit: Column) -> Column:
    return F.unhex(F.lpad(F.hex(unit), 4, "0"))


def escaped(text: Column) -> Column:
    """The inverse of `unescaped` for tabs, line ends, quotes and backslashes."""
    for plain, sign in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        text = F.replace(text, F.lit(plain), F.lit(sign))
    return text


def _value(term: Column) -> Column:
    return F.when(term.startswith('"'), unescaped(decoded(term))).otherwise(decoded(term))


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Decoded terms of a TSV reply: a header line, then a row per line. Missing cells are null; blank lines are skipped."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return raw.select(*(_value(F.col(c)).alias(c) for c in columns)).where(F.coalesce(*(F.col(c) for c in columns)).isNotNull())


def _term(c: str) -> Column:
    """URIs in angle brackets, blank nodes as they are, other terms in quotes."""
    uri = F.col(c).rlike("^(https?://|urn:)") & is_safe_uri(F.col(c))
    return F.when(uri, F.concat(F.lit("<"), c, F.lit(">"))).when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit('"'), escaped(F.col(c)), F.lit('"')))


def write_tsv(frame: DataFrame, path: str) -> None:
    """Statements (subject, predicate, object) as a TSV reply that `read_tsv` gives back."""
    frame.select(*(_term(c).alias(c) for c in ("subject", "predicate", "object"))).write.option("sep", "\t").option("header", True).option("quote", "").option("escapeQuotes", False).csv(path)


def write_ntriples(frame: DataFrame, path: str) -> None:
    """Statements (subject, predicate, object) as N-Triples that `read_ntriples` gives back; rows whose subject or predicate isn't a URI (or blank node) are left out."""
    ok = frame.where((F.col("subject").rlike("^(https?://|urn:)") & is_safe_uri(F.col("subject"))) | F.col("subject").rlike(r"^_:\S+$"))
    ok = ok.where(F.col("predicate").rlike("^(https?://|urn:)") & is_safe_uri(F.col("predicate")) & F.col("object").isNotNull())
    ok.select(F.concat_ws(" ", *(_term(c) for c in ("subject", "predicate", "object")), F.lit(".")).alias("value")).write.text(path)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object, lang), decoded; blank and comment lines, and `malformed` ones, are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(_NT))
    terms = (_value(F.regexp_extract("value", _NT, i)).alias(c) for i, c in enumerate(("subject", "predicate", "object"), 1))
    return lines.select(*terms, F.regexp_extract("value", r'"@([A-Za-z0-9-]+)\s*\.\s*$', 1).alias("lang"))


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines that hold something but no statement."""
    return spark.read.text(path).where(~F.col("value").rlike(_NT) & ~F.col("value").rlike(r"^\s*(#.*)?$"))
