"""Per-document text statistics, and the type of text they speak for.

Method: thresholds on the statistics are noisy labelling functions. Each votes for a type of text or abstains. The
functions' accuracies are learnt by expectation-maximization on how they agree over the whole corpus, without labels, and
every document gets the posterior of each type. Documents with the same votes have the same posterior, so the corpus
is reduced to counts of vote patterns (at most 4^8, whatever its size) before the iterations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Cut

TYPES = ("prose", "list", "junk")

# Common function words of English, French, German and Italian; CLAUSE are those that a finite clause rarely lacks.
CLAUSE = frozenset(
    "is was were are has have had been be would could that which who it he she we they did does not but because "
    "est était fut sont ont avait ne que qui dont il elle on nous mais pas "
    "ist war wurde sind hat haben wird dass nicht es er sie wir ich wo doch aber niemand "
    "è era fu sono ha aveva che non si vi ci ma lo".split()
)
COMMON = CLAUSE | frozenset(
    "the of and a an in to for with on by as from at this its his her or than when what like over into only such though while under after before between there some all both none so if "
    "le la les de des du un une et dans par sur au aux en pour ce cette son sa ses plus sous se comme encore après avant entre où si personne "
    "der die das den dem und von mit ein eine einer eines im am auf aus bei noch nach vor als zu zum sich keiner seit wie nur mehr über unter "
    "il gli di del della dei una uno per con nel nella al alla da dal più suo sua come prima dopo ancora sotto quello questo nessuno".split()
)
WORD = re.compile(r"[^\W\d_]+")
LINE = re.compile("\r\n?|\n|\v|\f|\u0085| | ")
SENTENCE_END = tuple(".!?…。:;") + tuple(x + y for x in ".!?…" for y in "\"'”’»)“")

STATS = "n_words int, mean_word_length double, symbol_ratio double, digit_ratio double, end_ratio double, common_ratio double, clause_ratio double, running_ratio double, words_per_line double, distinct_ratio double"
NAMES = [x.split()[0] for x in STATS.split(", ")]


def statistics(text: str) -> tuple:
    """The values of STATS for a text that isn't blank."""
    lines = [x for x in LINE.split(text) if x and not x.isspace()]
    chars = running = common = clause = ended = 0
    words: list[str] = []
    before = open_ = False
    for line in lines:
        found = WORD.findall(line.lower())
        c = sum(map(COMMON.__contains__, found))  # hardly a single letter is listed: symbol soup is full of them
        clause += sum(map(CLAUSE.__contains__, found))
        common += c
        words += found
        chars += len(line)
        # a line of running text, or the short last line of a paragraph that was broken into lines
        flows = len(found) >= 7 and c >= 0.25 * len(found) and line.count(",") <= 0.2 * len(found)
        flows = flows and len(set(found[:60])) >= 0.4 * len(found[:60])
        before = flows or (before and open_ and 0 < len(found) < 7)
        running += len(line) * before
        end = line.rstrip().endswith(SENTENCE_END)
        ended += end
        open_ = not end
    n = len(words)
    tokens = text.split()
    solid = sum(map(len, tokens))
    letters = sum(map(len, words))
    digits = sum(map(text.count, "0123456789"))
    near = [len(set(words[i : i + 40])) / len(words[i : i + 40]) for i in range(0, max(1, n - 20), 40)] if n else [1.0]
    return (
        n, solid / len(tokens), max(0, solid - letters - digits) / solid, digits / solid, ended / len(lines), common / n if n else 0.0,
        clause / n if n else 0.0, running / chars, n / len(lines), float(np.mean(near)),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(x.as_py()) for x in batch.column(1)]
        columns = list(zip(*rows)) or [()] * len(NAMES)
        arrays = [pa.array(columns[0], pa.int32()), *(pa.array(x, pa.float64()) for x in columns[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *NAMES])


def text_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, STATS...) of every row of documents (doc_id, text) whose text isn't null, empty or blank.

    n_words counts runs of letters; mean_word_length is the mean length of what white space separates; symbol_ratio and
    digit_ratio are shares of the characters that aren't white space; end_ratio is the share of lines that
    end in punctuation; common_ratio and clause_ratio are shares of the words; running_ratio is the share of characters
    in lines of running text; distinct_ratio is the mean share of different words in stretches of 40. Blank lines
    count as no lines. Repeated rows and null doc_ids are kept; whole texts are read, whatever their length.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.where(r"text rlike '[^\\s\\u0000-\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]'").mapInArrow(_measure, f"doc_id bigint, {STATS}")


@dataclass(frozen=True)
class Labeller:
    """Votes `low_type` below `low`, `high_type` from `high` on, and otherwise abstains. None abstains as well."""

    stat: str
    low: float
    low_type: str | None
    high: float
    high_type: str | None

    def vote(self) -> Column:
        x, none = F.col(self.stat), len(TYPES)
        number = lambda t: F.lit(none if t is None else TYPES.index(t))
        return F.when(x < self.low, number(self.low_type)).when(x >= self.high, number(self.high_type)).otherwise(F.lit(none))


LABELLERS = (
    Labeller("common_ratio", 0.22, "list", 0.32, "prose"),
    Labeller("clause_ratio", 0.02, "list", 0.05, "prose"),
    Labeller("running_ratio", 0.5, "list", 0.5, "prose"),
    Labeller("words_per_line", 6.0, "list", 9.0, "prose"),
    Labeller("symbol_ratio", 0.10, "prose", 0.35, "junk"),
    Labeller("digit_ratio", 0.05, None, 0.12, "list"),
    Labeller("mean_word_length", 2.2, "junk", 15.0, "junk"),
    Labeller("distinct_ratio", 0.40, "junk", 0.62, "prose"),
)


def learn(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, trust: float = 0.8, weight: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of votes, len(TYPES) = abstained): (posteriors per pattern, type shares, vote probabilities).

    vote probabilities[l, t, v]: labeller l votes v on texts of type t. They start from a labeller that is right with
    `trust` whenever it votes, and keep a prior of that form with the share `weight` of the corpus.
    """
    k, (n, m) = len(TYPES), patterns.shape
    prior = np.full((m, k, k + 1), (1 - trust) / k)
    prior[:, np.arange(k), np.arange(k)] = trust
    prior /= prior.sum(2, keepdims=True)
    probs, share = prior.copy(), np.full(k, 1 / k)
    each = np.eye(k + 1)[patterns]  # pattern, labeller, vote
    voted = patterns < k
    for _ in range(rounds):
        # an abstention says nothing
        logs = np.log(share) + np.einsum("plv,ltv->pt", each * voted[:, :, None], np.log(probs))
        post = np.exp(logs - logs.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * counts[:, None]
        share = (mass.sum(0) + 1) / (counts.sum() + k)
        seen = np.einsum("pt,plv->ltv", mass, each * voted[:, :, None])
        probs = seen + prior * weight * counts.sum()
        probs /= probs.sum(2, keepdims=True)
    return post, share, probs


def text_types(documents: DataFrame) -> DataFrame:
    """`text_statistics` with `text_type` (prose, list or junk), and `p_prose`, `p_list`, `p_junk`, the posterior of each.

    Null, empty and blank texts give no rows. Equal posteriors go to the type named first. An empty table gives no rows.
    """
    pattern = F.concat(*(x.vote().cast("string") for x in LABELLERS))
    measured = Cut(text_statistics(documents).withColumn("pattern", pattern)).df
    # at most 4^8 rows reach the driver, whatever the corpus
    found = measured.groupBy("pattern").count().orderBy("pattern").collect()
    probabilities = [f"p_{t}" for t in TYPES]
    schema = "pattern string, text_type string, " + ", ".join(f"{p} double" for p in probabilities)
    rows = []
    if found:
        votes = np.array([[int(v) for v in r["pattern"]] for r in found])
        post, _, _ = learn(votes, np.array([r["count"] for r in found], float))
        rows = [(r["pattern"], TYPES[int(p.argmax())], *map(float, p)) for r, p in zip(found, post)]
    known = documents.sparkSession.createDataFrame(rows, schema)
    return measured.join(F.broadcast(known), "pattern").select("doc_id", *NAMES, "text_type", *probabilities)
