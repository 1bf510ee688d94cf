"""Variant spellings of names typed by people: which entities are the same person or organisation.

Method: pigeonhole segment join. The parts of every name are cut into k + 1 segments; a part within k edits of another
contains at least one of the other's segments unchanged, shifted by k places at most. The shifted substrings are looked up
in an inverted index of segments, and what meets is verified by banded edit distance. The index key also holds what else must agree: a known
fact about the entity (its year or its place), for frequent or short words a fact with more, or, for names without a common fact, nothing at all if a
chance meeting is unlikely.

Entities that met in a part of their names are compared as a whole: the facts must not disagree, and every other part
of the shorter name must have its counterpart in the longer one: equal, misspelt, shortened, or an alias.
Three things are learnt from the data: aliases (nicknames, translations: two words that stand for each other in otherwise equal names
with all facts equal, for at least ALIAS_SUPPORT different names), words that don't tell bearers apart (left out in a share OPTIONAL of the names that have
them, of one entity or with all facts equal), and how likely two names agree by chance. Links are closed to classes by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import decoded, local_key, local_name
from ..functions.typed import int_value, trimmed
from ..session import Cut, cut

K = 2
SHORTEST = 5
ALIAS_SUPPORT = 2
#: names left out of and share of all names with a word, from which on it doesn't tell bearers apart
OPTIONAL_SUPPORT, OPTIONAL = 5, 0.25
#: a word is rare, like a surname that names one person, while fewer agreements in another word than this are expected among its bearers by chance
COINCIDENCE = 0.22
#: the chance that two names share a word before any names were seen, which counts as much as that of so many names
PRIOR_CHANCE, PRIOR_NAMES = 0.02, 1000
MAX_ALIASES = MAX_OPTIONAL = 200_000

# Words around a name that don't tell one bearer from another.
TITLES = "dr prof mr mrs ms herr frau sig sgr mme mlle sir dame"
PARTICLES = "von van de du der den del della di da la le zu zur zum of the and und et fo"
TRADES = "maler painter peintre pittore engraver graveur stecher incisore sculptor bildhauer sculpteur scultore artist"
FORMS = "ltd ev gmbh inc sa foundation stiftung fondation"
DROPPED = (TITLES + " " + PARTICLES + " " + TRADES + " " + FORMS).split()
_FROM = "áàâäãåéèêëíìîïóòôöõøúùûüçñýÿ"
_TO = "aaaaaaeeeeiiiioooooouuuucnyy"


def parts(label: Column) -> Column:
    """The words of a name in plain lower-case letters, without titles, particles, trades, legal forms and years."""
    t = F.regexp_replace(F.regexp_replace(label, r"\([^)]*\d{3,4}[^)]*\)", " "), r"\be\.\s?V\.\s*$", "")
    t = F.lower(t)
    t = F.regexp_replace(F.regexp_replace(F.translate(t, _FROM, _TO), "ß", "ss"), "æ|œ", "e")
    t = F.regexp_replace(F.regexp_replace(t, r"(?<=\p{L})0|0(?=\p{L})", "o"), r"(?<=\p{L})1|1(?=\p{L})", "l")
    t = F.regexp_replace(t, r"['’]s?\b|s['’](?=\s|$)", "")
    words = F.split(F.trim(F.regexp_replace(t, r"[^\p{L}]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(DROPPED))


def agents(triples: DataFrame, vertices: DataFrame, path: str = "/agent/") -> tuple[DataFrame, DataFrame]:
    """(uri, words, glued) for every distinct spelling, and (uri, year, place) for every uri, of entities under `path`.

    A label that is null, blank or the URI's local name is no spelling. `glued` holds all words without blanks.
    """
    ends = F.explode(F.array(F.struct(F.col("subject").alias("u"), F.col("subject_label").alias("l")), F.struct(F.col("object").alias("u"), F.col("object_label").alias("l"))))
    held = F.col("subject").contains(path) | F.col("object").contains(path)
    told = triples.where(held).select(ends.alias("x")).select("x.*").unionByName(vertices.where(F.col("name").contains(path)).select(F.col("name").alias("u"), F.col("label").alias("l")))
    told = told.select(decoded(F.col("u")).alias("uri"), trimmed(F.col("l")).alias("label")).where(F.col("uri").contains(path) & ~F.col("uri").startswith("_:"))
    told = told.distinct()
    named = told.where(F.col("label").isNotNull() & (F.col("label") != "") & (F.col("label") != local_name(F.col("uri"))))
    # "Surname, First" in the order of "First Surname"
    plain = F.regexp_replace(F.regexp_replace("label", r"\([^)]*\d{3,4}[^)]*\)", ""), r"^([^,]+),([^,]+)$", "$2$1")
    plain = F.regexp_replace(F.translate(F.lower(plain), _FROM, _TO), r"[^\p{L}]+", "")
    spelt = named.select("uri", parts(F.col("label")).alias("words"), plain.alias("glued")).where(F.size("words") > 0).distinct()
    p, s, o = local_key(F.col("predicate")), decoded(F.col("subject")), decoded(F.col("object"))
    facts = triples.where(F.col("subject").contains(path)).select(s.alias("uri"), p.alias("p"), o.alias("o")).where(F.col("p").isin("birth_year", "founded_year", "p74_has_current_or_former_residence"))
    year = F.min(F.when(F.col("p") != "p74_has_current_or_former_residence", int_value(trimmed(F.col("o")))))
    place = F.min(F.when((F.col("p") == "p74_has_current_or_former_residence") & (F.col("o") != "") & ~F.col("o").startswith("_:"), F.col("o")))
    known = facts.groupBy("uri").agg(year.alias("year"), place.alias("place"))
    return spelt, known


def _segments(length: int) -> list[tuple[int, int]]:
    """Start and length of the K + 1 segments of a string."""
    base, rest = divmod(length, K + 1)
    sizes = [base + (i >= K + 1 - rest) for i in range(K + 1)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def _index(entries: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for e in entries:
        rows = [(f"{fact}|{len(w)}|{i}|{w[a : a + n]}", fact, w) for fact, w in zip(e["fact"], e["word"]) for i, (a, n) in enumerate(_segments(len(w)))]
        yield pd.DataFrame(rows, columns=["key", "fact", "word"])


def _probes(entries: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Substrings of a word where a segment of a word at most K shorter can stand (multi-match-aware positions)."""
    for e in entries:
        rows = []
        for fact, w in zip(e["fact"], e["word"]):
            for length in range(max(SHORTEST, len(w) - K), len(w) + 1):
                more = len(w) - length
                for i, (a, n) in enumerate(_segments(length)):
                    for at in range(max(0, a - i, a + more - (K - i)), min(len(w) - n, a + i, a + more + K - i) + 1):
                        rows.append((f"{fact}|{length}|{i}|{w[at : at + n]}", fact, w))
        yield pd.DataFrame(rows, columns=["key", "fact", "word"])


def similar_words(entries: DataFrame) -> DataFrame:
    """(fact, word, other): words with the same fact within 2 edits (1, or a swap of two letters, if one has fewer than 8 letters), both ways and with themselves.

    Words of fewer than SHORTEST letters meet themselves only.
    """
    entries = cut(entries)
    long = entries.where(F.length("word") >= SHORTEST)
    schema = "key string, fact string, word string"
    index = long.mapInPandas(_index, schema).select(F.xxhash64("key").alias("key"), F.col("fact").alias("fact2"), F.col("word").alias("other"))
    probes = long.mapInPandas(_probes, schema).select(F.xxhash64("key").alias("key"), "fact", "word")
    met = probes.join(index, "key").where((F.col("fact") == F.col("fact2")) & (F.col("word") != F.col("other"))).select("fact", "word", "other").distinct()
    most = F.when(F.least(F.length("word"), F.length("other")) < 8, 1).otherwise(K)
    d = F.levenshtein("word", "other", K)
    letters = lambda c: F.array_sort(F.split(c, ""))
    swapped = (d == 2) & (F.length("word") == F.length("other")) & (letters("word") == letters("other"))
    close = met.where((d >= 0) & ((d <= most) | swapped))
    back = close.select("fact", F.col("other").alias("word"), F.col("word").alias("other"))
    return close.unionByName(back).unionByName(entries.select("fact", "word", F.col("word").alias("other"))).distinct()


def _edits(a: str, b: str, most: int) -> bool:
    """Whether a and b are within `most` edits, a swap of neighbours counting as one; only a band of the table is filled."""
    if abs(len(a) - len(b)) > most:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before[j - 2] + 1)
        before, last = last, row
    return last[len(b)] <= most


def _stands_for(a: str, b: str, aliases: set, most: int = K) -> bool:
    if a == b or (a, b) in aliases:
        return True
    short, long = sorted((a, b), key=len)
    if long.startswith(short):
        return True
    if len(short) <= 4 and short[0] == long[0]:  # an abbreviation keeps some letters in their order
        rest = iter(long)
        return len(short) > 1 and all(c in rest for c in short)
    return len(short) >= 4 and _edits(a, b, 1 if len(short) < 8 else most)


def compatible(a: list[str], b: list[str], aliases: set, most: int = K) -> bool:
    """Whether every word of the shorter list has a counterpart of its own in the longer one, misspelt by `most` edits if long; initials may stand for several words."""
    short, long = sorted((list(a), list(b)), key=len)
    left = list(long)
    for w in sorted(short, key=len, reverse=True):
        found = next((x for x in left if x == w), None) or next((x for x in left if _stands_for(w, x, aliases, most)), None)
        if found is None:
            if 2 <= len(w) <= 4 and len(left) >= len(w) and sorted(w) == sorted(x[0] for x in left)[: len(w)]:
                return True
            return False
        left.remove(found)
    return True


def _without(words: list[str], core: str) -> list[str]:
    out = list(words)
    if core in out:
        out.remove(core)
    return out


def _verify(aliases: set, most: int = K):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for wa, wb, ca, cb, both in zip(f["words_a"], f["words_b"], f["core_a"], f["core_b"], f["both"]):
                if both or ca == "" or cb == "":
                    keep.append(True)
                    continue
                ra, rb = _without(wa, ca), _without(wb, cb)
                keep.append(bool(ra) and bool(rb) and compatible(ra, rb, aliases, most))
            yield f.loc[keep, ["uri_a", "uri_b"]]

    return run


def classes(links: DataFrame) -> DataFrame:
    """(uri, class): connected components of (uri_a, uri_b) by star contraction; class is the smallest uri."""
    both = links.select("uri_a", "uri_b").where("uri_a <> uri_b")
    state = Cut(both.unionByName(both.select(F.col("uri_b").alias("uri_a"), F.col("uri_a").alias("uri_b"))).groupBy(F.col("uri_a").alias("uri")).agg(F.least(F.min("uri_b"), F.first("uri_a")).alias("class")))
    edges = Cut(both.distinct())
    while True:
        t = state.df
        a = t.select(F.col("uri").alias("uri_a"), F.col("class").alias("ca"))
        b = t.select(F.col("uri").alias("uri_b"), F.col("class").alias("cb"))
        e = edges.df.join(a, "uri_a").join(b, "uri_b")
        # a class that touches a smaller one points to it, then every uri follows its class twice
        hook = e.where("ca <> cb").select(F.greatest("ca", "cb").alias("class"), F.least("ca", "cb").alias("to")).groupBy("class").agg(F.min("to").alias("to"))
        hook = Cut(hook)
        if hook.df.isEmpty():
            edges.drop()
            return t
        jump = hook.df.join(hook.df.select(F.col("class").alias("to"), F.col("to").alias("to2")), "to", "left").select("class", F.coalesce("to2", "to").alias("to"))
        moved = t.join(jump, "class", "left").select("uri", F.coalesce("to", "class").alias("class"))
        nxt = Cut(moved)
        hook.drop()
        state.drop()
        state = nxt


def optional_words(spelt: DataFrame) -> list[str]:
    """Words of names (uri, year, place, words) that don't tell bearers apart: in at least OPTIONAL of the names that have one, and OPTIONAL_SUPPORT of them, the same
    name without it is found for the same uri, or for another one with both facts equal. Bounded by MAX_OPTIONAL."""
    both = F.concat(F.lit("y"), "year", F.lit("|"), "place")
    block = F.explode(F.filter(F.array("uri", both), lambda x: x.isNotNull())).alias("block")
    name = lambda words: F.array_join(F.array_sort(words), " ")
    rows = spelt.select(block, "words").withColumn("name", name("words"))
    less = rows.select("block", "name", F.explode(F.array_distinct("words")).alias("word"), F.col("words").alias("w")).withColumn("rest", name(F.array_remove("w", F.col("word")))).where("rest <> ''")
    shorter = less.join(rows.select("block", F.col("name").alias("rest")).distinct(), ["block", "rest"], "left_semi").groupBy("word").agg(F.count_distinct("name").alias("left"))
    names = less.groupBy("word").agg(F.count_distinct("name").alias("names"))
    found = shorter.where(F.col("left") >= OPTIONAL_SUPPORT).join(names, "word").where(F.col("left") >= OPTIONAL * F.col("names")).select("word").limit(MAX_OPTIONAL + 1).collect()
    if len(found) > MAX_OPTIONAL:
        raise ValueError("more words that tell nothing than a vocabulary of names can have")
    return sorted(r["word"] for r in found)


def same_entities(triples: DataFrame, vertices: DataFrame, types: DataFrame, path: str = "/agent/") -> DataFrame:
    """(uri_a, uri_b), uri_a < uri_b: all pairs of URIs that stand for the same person or organisation, from `entity_classes`.

    Facts that are both known and differ keep two URIs of a class apart.
    """
    found = cut(entity_classes(triples, vertices, types, path))
    left = found.select("class", *(F.col(c).alias(f"{c}_a") for c in ("uri", "year", "place")))
    right = found.select("class", *(F.col(c).alias(f"{c}_b") for c in ("uri", "year", "place")))
    agree = "NOT coalesce(year_a <> year_b, false) AND NOT coalesce(place_a <> place_b, false)"
    return left.join(right, "class").where("uri_a < uri_b").where(agree).select("uri_a", "uri_b").distinct()


def entity_classes(triples: DataFrame, vertices: DataFrame, types: DataFrame, path: str = "/agent/") -> DataFrame:
    """(uri, class, year, place) of every URI that stands for the same person or organisation as another one; class is the smallest URI of them.

    Facts (birth or founding year, residence) that are both known and differ are never linked; of several values of a
    URI the smallest counts. URIs that share no known fact are linked by a rare word of 8 letters or more, misspelt only between persons with another word in common, beside
    matching ones (by one edit at most), or by equal words, and only if all that they lead to agree in what is known of them. `types` (uri, type_uri) tells persons (E21_Person) from others. Null, blank
    and local-name labels are no spellings; a URI without a spelling isn't linked. Repeated rows change nothing; empty tables give no rows; other columns are ignored.
    """
    told, known = agents(triples, vertices, path)
    persons = types.where(F.col("uri").contains(path)).select(decoded(F.col("uri")).alias("uri"), (local_key(F.col("type_uri")) == "e21_person").alias("p"))
    raw = Cut(told.join(known, "uri", "left").join(persons.groupBy("uri").agg(F.max("p").alias("person")), "uri", "left"))
    dropped = optional_words(raw.df)
    kept = F.array_except("words", F.array(*(F.lit(w) for w in dropped)).cast("array<string>")) if dropped else F.col("words")
    # a name of nothing but such words keeps them
    spelt = raw if not dropped else Cut(raw.df.withColumn("words", F.when(F.size(kept) > 0, F.filter("words", lambda w: ~w.isin(dropped))).otherwise(F.col("words"))))
    n_agents = spelt.df.select("uri").distinct().count()
    word = spelt.df.select("uri", "year", "place", "person", "words", F.explode("words").alias("word"))
    counts = Cut(word.select("word", "uri").distinct().groupBy("word").agg(F.count("*").alias("n")))
    # the chance that two names share a word, so how many bearers of a word make an agreement in another one likely
    pairs_sharing = counts.df.agg(F.sum(F.col("n") * (F.col("n") - 1.0))).first()[0] or 0.0
    chance = (pairs_sharing + PRIOR_CHANCE * PRIOR_NAMES**2) / (float(n_agents) ** 2 + PRIOR_NAMES**2)
    counts, rare_most = counts.df, COINCIDENCE / chance
    #: words of more bearers than this need a narrower key; they are kept, so it changes the work but not which names can meet
    most = max(20, 4 * n_agents**0.5)
    known_facts = F.filter(F.array(F.concat(F.lit("y"), F.col("year")), F.col("place")), lambda x: x.isNotNull())
    fact = F.explode(known_facts)
    name = F.coalesce(F.col("person") & (F.col("n") <= rare_most) & (F.length("word") >= 8), F.lit(False))
    every = word.where(F.length("word") >= 3).join(counts, "word").withColumn("name", name)
    wide = (F.col("n") <= most) & (F.length("word") >= SHORTEST)
    columns = ("uri", "year", "place", "words", "word", "name")
    core = every.where(wide).select(*columns, fact.alias("fact"))
    # frequent and short words meet, also with their misspellings, under both facts or a fact with the initial of another word
    initials = F.transform(F.array_except("words", F.array("word")), lambda w: F.substring(w, 1, 1))
    narrow = F.flatten(F.transform(known_facts, lambda f: F.transform(initials, lambda i: F.concat(f, F.lit("|"), i))))
    narrow = F.explode(F.array_distinct(F.concat(narrow, F.filter(F.array(F.concat(F.lit("y"), "year", F.lit("|"), "place")), lambda x: x.isNotNull()))))
    hot = Cut(every.where(~wide).select(*columns, narrow.alias("fact")))
    beside = every.where(wide).select(*columns, narrow.alias("fact")).join(hot.df.select("fact").distinct(), "fact", "left_semi")
    core = core.unionByName(hot.df).unionByName(beside.select(*core.columns))
    core = Cut(core)
    close = Cut(similar_words(core.df.select("fact", "word").distinct()))
    side = lambda s: core.df.select("fact", *(F.col(c).alias(f"{c}_{s}") for c in ("uri", "year", "place", "words", "name")), F.col("word").alias(f"core_{s}"))
    a = side("a").join(close.df.select("fact", F.col("word").alias("core_a"), F.col("other").alias("core_b")), ["fact", "core_a"])
    agree = "NOT coalesce(year_a <> year_b, false) AND NOT coalesce(place_a <> place_b, false)"
    pairs = a.join(side("b"), ["fact", "core_b"]).where("uri_a < uri_b").where(agree)
    both = F.coalesce((F.col("year_a") == F.col("year_b")) & (F.col("place_a") == F.col("place_b")), F.lit(False))
    both = both | ((F.col("core_a") == F.col("core_b")) & F.col("name_a") & F.col("name_b"))
    pairs = Cut(pairs.select("uri_a", "uri_b", "words_a", "words_b", "core_a", "core_b", both.alias("both")).distinct())

    # words that stand for each other beside an equal core, with all facts equal
    single = pairs.df.where("both AND core_a = core_b AND size(words_a) = 2 AND size(words_b) = 2")
    other = lambda s: F.try_element_at(F.array_except(f"words_{s}", F.array(f"core_{s}")), F.lit(1))
    stood = single.select("core_a", other("a").alias("x"), other("b").alias("y")).where("x <> y AND length(x) > 1 AND length(y) > 1")
    stood = stood.select("core_a", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).groupBy("x", "y").agg(F.count_distinct("core_a").alias("n"))
    learnt = stood.where(F.col("n") >= ALIAS_SUPPORT).limit(MAX_ALIASES + 1).collect()
    if len(learnt) > MAX_ALIASES:
        raise ValueError("more aliases than a vocabulary of names can have")
    aliases = {p for r in learnt for p in ((r["x"], r["y"]), (r["y"], r["x"]))}
    # each kind of link is written on its own: one plan of them all is planned again after each of its stages, which takes the driver's memory
    links = [cut(pairs.df.mapInPandas(_verify(aliases), "uri_a string, uri_b string").distinct())]

    # beside frequent and short words, words that stand for each other with another initial meet under a fact with the two of them
    turned = sorted((x, y) for x, y in aliases if x[0] != y[0])
    if turned:
        turned = spelt.df.sparkSession.createDataFrame(turned, "beside string, stands string")
        told_by = every.select("uri", "year", "place", "words", "word", wide.alias("wide"), fact.alias("fact")).select("*", F.explode(F.array_except("words", F.array("word"))).alias("beside"))
        two = told_by.join(turned, "beside").withColumn("fact", F.concat_ws("|", "fact", F.least("beside", "stands"), F.greatest("beside", "stands"))).withColumn("first", F.col("beside") < F.col("stands"))
        two = Cut(two.select("uri", "year", "place", "words", "word", "wide", "fact", "first"))
        # two words that are neither frequent nor short have met already
        two_hot = cut(two.df.join(two.df.where("NOT wide").select("fact").distinct(), "fact", "left_semi"))
        near = Cut(similar_words(two_hot.select("fact", "word").distinct()))
        half = lambda s, which: two_hot.where(which).select("fact", *(F.col(c).alias(f"{c}_{s}") for c in ("uri", "year", "place", "words")), F.col("word").alias(f"core_{s}"))
        met = half("a", "first").join(near.df.select("fact", F.col("word").alias("core_a"), F.col("other").alias("core_b")), ["fact", "core_a"]).join(half("b", "NOT first"), ["fact", "core_b"])
        met = met.where("uri_a <> uri_b").where(agree).select("uri_a", "uri_b", "words_a", "words_b", "core_a", "core_b", F.lit(False).alias("both")).distinct()
        links.append(cut(met.mapInPandas(_verify(aliases), "uri_a string, uri_b string").distinct()))

    # without a known fact in common only a rare word can start a comparison, and all that it leads to must agree with each other
    rare = word.where(F.length("word") >= 8).join(counts.where(F.col("n") <= rare_most), "word").select("uri", "year", "place", "person", "words", "word")
    rare = Cut(rare.distinct())
    end = lambda s: rare.df.select("word", *(F.col(c).alias(f"{c}_{s}") for c in ("uri", "year", "place", "person", "words")))
    apart = "NOT coalesce(year_a = year_b, false) AND NOT coalesce(place_a = place_b, false)"
    alone = end("a").join(end("b"), "word").where("uri_a < uri_b").where(agree).where(apart)
    alone = alone.select("uri_a", "uri_b", "words_a", "words_b", F.col("word").alias("core_a"), F.col("word").alias("core_b"), F.lit(False).alias("both"))
    alone = Cut(alone.mapInPandas(_verify(aliases, 1), "uri_a string, uri_b string").distinct()).df
    # so can a misspelt one between persons with another word in common
    near = cut(similar_words(rare.df.where("person").select(F.lit("").alias("fact"), "word").distinct()).where("word <> other").select("word", "other"))
    astray = end("a").where("person_a").join(near, "word").withColumnRenamed("word", "core_a").join(end("b").where("person_b").withColumnRenamed("word", "other"), "other").where("uri_a < uri_b").where(agree).where(apart)
    astray = astray.withColumnRenamed("other", "core_b").where("arrays_overlap(array_except(words_a, array(core_a)), array_except(words_b, array(core_b)))")
    astray = Cut(astray.select("uri_a", "uri_b", "words_a", "words_b", "core_a", "core_b", F.lit(False).alias("both")).mapInPandas(_verify(aliases, 1), "uri_a string, uri_b string").distinct()).df
    facts = spelt.df.select("uri", "year", "place").distinct()

    def agreed(met: DataFrame) -> DataFrame:
        ways = met.unionByName(met.select(F.col("uri_b").alias("uri_a"), F.col("uri_a").alias("uri_b")))
        seen = ways.join(facts.withColumnRenamed("uri", "uri_b"), "uri_b").groupBy(F.col("uri_a").alias("uri")).agg(F.min("year").alias("y1"), F.max("year").alias("y2"), F.min("place").alias("p1"), F.max("place").alias("p2"))
        single = cut(seen.where("NOT coalesce(y1 <> y2, false) AND NOT coalesce(p1 <> p2, false)").select("uri"))
        return cut(met.join(single.withColumnRenamed("uri", "uri_a"), "uri_a", "left_semi").join(single.withColumnRenamed("uri", "uri_b"), "uri_b", "left_semi").select("uri_a", "uri_b"))

    links += [agreed(alone), agreed(cut(alone.unionByName(astray).distinct()))]

    # names typed without blanks meet on all their letters, with a fact; equal words meet with a fact, or without one
    glued = spelt.df.select("uri", "year", "place", "glued", fact.alias("fact"))
    heads = glued.groupBy("glued", "fact").agg(F.min("uri").alias("uri_a"), F.min("year").alias("y1"), F.max("year").alias("y2"), F.min("place").alias("p1"), F.max("place").alias("p2"))
    sure = "NOT coalesce(y1 <> y2, false) AND NOT coalesce(p1 <> p2, false)"
    links.append(cut(glued.join(heads.where(sure), ["glued", "fact"]).select("uri_a", F.col("uri").alias("uri_b")).where("uri_a <> uri_b")))
    # a namesake of another year or place must not part those who share one: each fact, both facts and no fact have groups of their own
    told = F.explode(F.concat(known_facts, F.array(F.coalesce(F.concat(F.lit("y"), "year", F.lit("|"), "place"), F.lit("")), F.lit(""))))
    equal = spelt.df.where("size(words) > 1").select("uri", "year", "place", F.array_join(F.array_sort("words"), " ").alias("name"), told.alias("fact")).distinct()
    heads = equal.groupBy("name", "fact").agg(F.min("uri").alias("uri_a"), F.min("year").alias("y1"), F.max("year").alias("y2"), F.min("place").alias("p1"), F.max("place").alias("p2"))
    links.append(cut(equal.join(heads.where(sure), ["name", "fact"]).select("uri_a", F.col("uri").alias("uri_b")).where("uri_a <> uri_b")))

    return classes(cut(reduce(DataFrame.unionByName, links).distinct())).join(spelt.df.select("uri", "year", "place").distinct(), "uri")
