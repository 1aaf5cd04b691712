"""Quality by weak supervision: rules vote or abstain, expectation-maximisation estimates how
far each rule can be trusted, and a document is kept by its posterior quality probability.

A document is good or one of several kinds of junk, one kind to start with for each rule.  Every kind has its
own probability that a rule which votes on it votes bad; an abstention says nothing.  So rules that see
the same junk become a kind together and do not count as independent witnesses, and junk that a single
rule sees need not be explained as a habit of good documents.  Estimates start at and are drawn towards a prior
that weighs a tenth of the corpus, whatever its size; none is cut off.

Every expression is a built-in Spark function.  The estimation works on vote patterns, of which
there are at most ``3 ** len(RULES)`` whatever the corpus holds, folded into one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .common import ROW, carried, carry, whole_text

# Words are runs of anything but space and the five ASCII control spaces.
SPACES = r"[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Votes bad, votes good, or abstains; bad is looked at first."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 10", "n_words >= 25"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words",
         "word_chars >= 4 * n_words AND word_chars <= 8 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "n_lines >= 2 AND n_dup_lines = 0"),
    Rule("repeats", "5 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words"),
    Rule("exclaim", "4 * n_exclaim > n_words", "20 * n_exclaim <= n_words"),
)
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"

ITERATIONS = 40
# Prior, and start: the share of each kind of junk, and the probability of a bad vote, where the rule votes,
# on a good document, on the rule's own kind of junk and on another rule's kind.
JUNK_SHARE, BAD_ON_GOOD, BAD_ON_OWN, BAD_ON_OTHER = 0.02, 0.005, 0.8, 0.1
PRIOR_WEIGHT = 0.1  # documents that the prior stands for, as a share of the corpus


def _removed(symbols: str, text: str = "text") -> str:
    """Occurrences of the ASCII characters ``symbols``, by the bytes left without each."""
    return " + ".join(f"octet_length({text}) - octet_length(replace({text}, '{s}', ''))" for s in symbols)


# Positions of the 5-word windows found twice or more, ascending: windows sorted by their words,
# a window stays when a neighbour in that order has the same words.
_REPEATED = """array_sort(transform(filter(sorted, (x, k) ->
    (k > 0 AND sorted[k - 1].w = x.w) OR (k + 1 < size(sorted) AND sorted[k + 1].w = x.w)), x -> x.p))"""
_SORTED = """CASE WHEN suspect THEN array_sort(transform(sequence(0, size(words) - 5),
    i -> struct(concat_ws(' ', words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) AS w, i AS p)))
    ELSE array() END"""
# 64-bit window hashes that are all different prove that no window repeats; only other texts are sorted.
_HASHES = """CASE WHEN size(words) < 6 THEN array() ELSE transform(sequence(0, size(words) - 5),
    i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])) END"""
_COVERED = """CASE WHEN size(repeated) = 0 THEN 0L ELSE 5L + aggregate(sequence(1, size(repeated)), 0L,
    (n, k) -> n + CASE WHEN k < size(repeated) THEN least(5, repeated[k] - repeated[k - 1]) ELSE 0 END) END"""


def signals(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Per input row (packed as ``_row``) the counts that the rules use: n_words, word_chars,
    n_symbols, n_exclaim, n_lines, n_dup_lines, n_repeat_words.  A null text counts as empty:
    all counts are zero."""
    steps = [
        {"words": f"filter(split(text, '{SPACES}'), w -> w <> '')",
         "lines": "filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')",
         "n_symbols": f"CAST({_removed(SYMBOLS)} AS BIGINT)", "n_exclaim": f"CAST({_removed('!')} AS BIGINT)"},
        {"hashes": _HASHES},
        {"suspect": "size(array_distinct(hashes)) < size(hashes)"},
        {"sorted": _SORTED},
        {"repeated": _REPEATED},
    ]
    out = carry(docs, text=whole_text(text_column))
    for step in steps:
        out = out.withColumns({k: F.expr(v) for k, v in step.items()})
    return out.select(
        ROW,
        F.expr("CAST(size(words) AS BIGINT)").alias("n_words"),
        F.expr("CAST(char_length(array_join(words, '')) AS BIGINT)").alias("word_chars"),
        "n_symbols", "n_exclaim",
        F.expr("CAST(size(lines) AS BIGINT)").alias("n_lines"),
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)").alias("n_dup_lines"),
        F.expr(_COVERED).alias("n_repeat_words"),
    )


def votes_sql(rules=RULES) -> str:
    return "array(" + ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in rules) + ")"


def _likelihoods_sql(state: str, v: str, n_rules: int) -> str:
    """Per kind (good first) its share times the probability of the votes given."""
    return f"""transform(sequence(0, {n_rules}), c -> {state}.share[c] * aggregate(sequence(0, {n_rules - 1}), 1D,
        (t, j) -> t * CASE {v}[j] WHEN -1 THEN {state}.bad[c][j] WHEN 1 THEN 1D - {state}.bad[c][j] ELSE 1D END))"""


def posterior_sql(state: str, v: str, n_rules: int = len(RULES)) -> str:
    """P(good | votes)."""
    return f"transform(array({_likelihoods_sql(state, v, n_rules)}), l -> l[0] / aggregate(l, 0D, (t, x) -> t + x))[0]"


def _fit_sql(n_rules: int) -> str:
    """The expectation-maximisation over ``patterns`` (votes, n), as one fold.  Kind 0 is good, kind j + 1
    starts as what rule j sees."""
    kinds, rules = f"sequence(0, {n_rules})", f"sequence(0, {n_rules - 1})"
    share_prior = f"CASE WHEN c = 0 THEN {1 - JUNK_SHARE * n_rules}D ELSE {JUNK_SHARE}D END"
    bad_prior = f"CASE WHEN c = 0 THEN {BAD_ON_GOOD}D WHEN c = j + 1 THEN {BAD_ON_OWN}D ELSE {BAD_ON_OTHER}D END"
    weight = f"{PRIOR_WEIGHT}D * total"

    def summed(where: str) -> str:
        return f"aggregate(ps, 0D, (t, p) -> t + CASE WHEN {where} THEN p.w[c] ELSE 0D END)"

    # per pattern the documents of each kind
    responsible = f"""transform(array({_likelihoods_sql('s', 'p.votes', n_rules)}),
        l -> transform(l, x -> p.n * x / aggregate(l, 0D, (t, y) -> t + y)))[0]"""
    return f"""aggregate(sequence(1, {ITERATIONS}),
      named_struct('share', transform({kinds}, c -> {share_prior}), 'bad', transform({kinds}, c -> transform({rules}, j -> {bad_prior}))),
      (s, i) -> transform(array(transform(patterns, p -> struct(p.votes AS votes, {responsible} AS w))),
        ps -> named_struct(
          'share', transform({kinds}, c -> ({weight} * {share_prior} + {summed('true')}) / ({weight} + total)),
          'bad', transform({kinds}, c -> transform({rules}, j ->
             ({weight} * {share_prior} * {bad_prior} + {summed('p.votes[j] = -1')}) / ({weight} * {share_prior} + {summed('p.votes[j] <> 0')})))))[0])"""


def pattern_posteriors(voted: DataFrame, n_rules: int = len(RULES)) -> DataFrame:
    """One row per vote pattern present (at most ``3 ** n_rules``) with its posterior ``p_good`` and the
    estimates ``state``: ``share`` of each kind and, per kind and rule, the probability ``bad`` of a bad vote.

    Pattern counts are summed map-side; the estimate is a fold over the one row that holds them.
    """
    counts = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    one = counts.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"), F.sum("n").alias("total"))
    fitted = one.withColumn("state", F.expr(_fit_sql(n_rules)))
    return fitted.select("state", F.explode("patterns").alias("p")).select(
        F.col("p.votes").alias("votes"), F.expr(posterior_sql("state", "p.votes", n_rules)).alias("p_good"), "state")


def judged(docs: DataFrame, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per input row (packed as ``_row``): the counts, ``votes``, ``base_failed``, ``p_good`` and
    ``kept`` (not ``base_failed`` and ``p_good >= threshold``).

    Repeated rows are judged alike, extra columns are carried and never clash, an empty table gives
    no rows.  The counts are written once to the shared folder, since both the estimate and the
    verdict read them.  All documents are used to estimate, those that fail the base rule too: they
    are where its rules are seen to vote bad.
    """
    voted = write_through(signals(docs, text_column).withColumns(
        {"votes": F.expr(votes_sql()), "base_failed": F.expr(BASE_FAILED)}), "quality-votes")
    posteriors = pattern_posteriors(voted.select("votes")).drop("state")
    return voted.join(F.broadcast(posteriors), "votes", "left").withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def quality_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id with the counts, verdict, posterior and votes; the text is not carried."""
    return judged(docs.select(id_column, text_column), text_column).select(
        F.col(ROW).getField(id_column).alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def keep_good(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The input rows, with the input's columns, that are kept."""
    return carried(judged(docs, text_column).where("kept"), docs.columns)
