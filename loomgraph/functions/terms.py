"""Column expressions on RDF terms as they stand in a TSV reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: a quoted literal with an optional language tag or datatype
QUOTED = r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$'


def decoded(term: Column) -> Column:
    """`<uri>` -> uri, `"text"@lang` and `"text"^^<type>` -> text, anything else unchanged, null -> null."""
    return (
        F.when(term.startswith("<") & term.endswith(">"), term.substr(F.lit(2), F.length(term) - 2))
        .when(term.startswith('"') & term.rlike(QUOTED), F.regexp_extract(term, QUOTED, 1))
        .otherwise(term)
    )


def named(term: Column) -> Column:
    """True for a decoded term that names something: not null, empty or a blank node."""
    return F.coalesce((term != "") & ~term.startswith("_:"), F.lit(False))


def local_name(uri: Column) -> Column:
    """What follows the last `/` or `#`."""
    return F.regexp_extract(uri, r"([^/#]*)$", 1)


def local_key(uri: Column) -> Column:
    """The local name in the form in which predicates and classes are compared."""
    return F.lower(local_name(decoded(uri)))


# Codes of three letters for the languages of the collection.
LANGUAGES = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "ita": "it"}


def language(tag: Column) -> Column:
    """`EN`, `en-GB` and `eng` -> en; null stays null."""
    code = F.lower(F.regexp_extract(F.trim(tag), r"^([A-Za-z]*)", 1))
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), code)
