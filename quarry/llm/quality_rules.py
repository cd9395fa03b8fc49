"""Quality rules by weak supervision [native].

Every rule looks at one statistic of a text and votes good, votes bad or
abstains.  Nobody labels anything: expectation-maximisation over the vote
patterns estimates how often each rule says what for either class, and a text
is kept if its posterior probability of being good reaches one half.  A base
filter (too short, too repetitive) comes first and cannot be outvoted.

The statistics are built-in expressions within one row, so the only shuffle is
the count of vote patterns, of which there are at most ``3 ** len(RULES)``
however large the corpus; that count is all the driver ever sees.

Nulls: a null text has no words, so every count is 0, it fails the base filter
and isn't kept.  A null doc_id stays null.  Repeated rows are judged one by
one and get equal verdicts.  An empty table gives an empty result.  Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bind, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Frequent words of the corpus languages; natural prose has some of them.
STOP_WORDS = (
    "the of and to in is it that for on with as was be by this are at from or an "
    "le la les de des et en un une du que est pour dans qui sur par pas au avec "
    "der die das und ist ein eine den von zu mit auf für im dem nicht als auch "
    "el los las y del se por con una para no lo es como"
).split()

#: name: (share, direction, votes good up to, votes bad from); shares are of words, letters or lines.
#: A rule without a limit for good can only accuse: most texts have no such fault, which praises none of them.
RULES = {
    "symbols": ("symbol_share", "<", None, 0.15),
    "repeats": ("repeat_share", "<", None, 0.30),
    "lines": ("dup_line_share", "<", None, 0.30),
    "capitals": ("capital_share", "<", None, 0.50),
    "shouting": ("bang_share", "<", None, 0.20),
    "lists": ("bar_share", "<", None, 0.10),
    "letters": ("letter_share", ">", 0.85, 0.70),
    "stop_words": ("stop_share", ">", 0.08, 0.02),
    "length": ("mean_word", "<", 9.0, 14.0),
}
#: Before any text is seen: how often a rule says good, nothing or bad, by class.
ACCUSERS = ({1: 0.001, 0: 0.699, -1: 0.3}, {1: 0.001, 0: 0.989, -1: 0.01})
JUDGES = ({1: 0.4, 0: 0.3, -1: 0.3}, {1: 0.8, 0: 0.18, -1: 0.02})
#: That belief counts as so many texts, a fifth of them bad.
PRIOR_TEXTS = 20.0


def _grams(w: Column) -> Column:
    """Hashes of the 3-word windows, in order."""
    pair = lambda a, b: F.xxhash64(a, b)

    def triples(h: Column) -> Column:
        n = F.size(h)
        two = F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), pair)
        return F.when(n >= 3, bind(two, lambda t: F.zip_with(F.slice(t, 1, n - 2), F.slice(h, 3, n - 2), pair))).otherwise(F.array().cast("array<bigint>"))

    return bind(F.transform(w, lambda x: F.xxhash64(x)), triples)


def _covered(grams: Column) -> Column:
    """Words inside windows that occur twice or more: sort (hash, place), keep equal neighbours, unite the intervals."""

    def places(s: Column) -> Column:
        at = lambda i: F.get(s, i)["h"]
        twins = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: F.coalesce(at(i) == at(i - 1), F.lit(False)) | F.coalesce(at(i) == at(i + 1), F.lit(False)),
        )
        return F.sort_array(F.transform(twins, lambda i: F.get(s, i)["i"]))

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.flatten(F.transform(F.array(pairs), places))  # bind() took twice the time here
    united = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + (p + 3) - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), united).otherwise(F.lit(0).cast("bigint"))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the contract's counts, and the shares that the rules look at; columns of ``keep`` come along."""
    t = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", *keep, t.alias("text")).withColumn("w", words(F.col("text")))
    base = base.withColumn("g", _grams(F.col("w")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    solid = F.translate("text", " \t\n\x0b\x0c\r", "")
    n_in = lambda c, chars: F.char_length(c) - F.char_length(F.translate(c, chars, ""))
    base = base.withColumn("lines", lines).withColumn("solid", solid)
    out = base.select(
        "doc_id",
        *keep,
        F.size("w").cast("bigint").alias("n_words"),
        F.char_length("solid").cast("bigint").alias("word_chars"),
        n_in(F.col("text"), "#*$%&|<>").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        _covered(F.col("g")).alias("n_repeat_words"),
        F.char_length(F.regexp_replace("solid", "\\P{L}+", "")).cast("bigint").alias("letters"),
        F.char_length(F.regexp_replace("solid", "\\P{Lu}+", "")).cast("bigint").alias("capitals"),
        n_in(F.col("text"), "!").cast("bigint").alias("bangs"),
        n_in(F.col("text"), "|").cast("bigint").alias("bars"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("bigint").alias("stops"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select(
        "*",
        share("n_symbols", "n_words").alias("symbol_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("letters", "word_chars").alias("letter_share"),
        share("capitals", "letters").alias("capital_share"), share("bangs", "n_words").alias("bang_share"),
        share("bars", "n_words").alias("bar_share"), share("stops", "n_words").alias("stop_share"),
        share("word_chars", "n_words").alias("mean_word"),
    )


def vote(name: str) -> Column:
    """1 good, -1 bad, 0 abstains; texts without words leave every rule without a say."""
    share, way, good, bad = RULES[name]
    x = F.col(share)
    beyond, within = (x >= bad, x <= F.lit(good)) if way == "<" else (x <= bad, x >= F.lit(good))
    says = F.when(beyond, -1) if good is None else F.when(beyond, -1).when(within, 1)
    return F.when(F.col("n_words") > 0, says.otherwise(0)).otherwise(0)


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior: float = PRIOR_TEXTS) -> tuple[float, list[list[dict[int, float]]]]:
    """EM over (votes, number of texts).

    Starts from ``ACCUSERS`` and ``JUDGES``, which keeps the classes from changing
    places.  The same belief stays in as pseudo-counts of ``prior`` texts however
    large the corpus, so accuracies are the corpus's own but for tiny ones.
    Returns the share of good texts and, by class and rule, vote probabilities.
    """
    rules = len(RULES)
    total = sum(n for _, n in patterns)
    belief = [[dict((ACCUSERS if good is None else JUDGES)[k]) for _, _, good, _ in RULES.values()] for k in (0, 1)]
    share, says = 0.8, belief
    for _ in range(rounds if total else 0):
        weight = [prior * 0.2, prior * 0.8]
        seen = [[{v: weight[k] * belief[k][r][v] for v in (1, 0, -1)} for r in range(rules)] for k in (0, 1)]
        mass = list(weight)
        for votes, n in patterns:
            good = n * posterior(votes, share, says)
            for k, m in ((0, n - good), (1, good)):
                mass[k] += m
                for r, v in enumerate(votes):
                    seen[k][r][v] += m
        new = mass[1] / sum(mass)
        says = [[{v: c / sum(x.values()) for v, c in x.items()} for x in seen[k]] for k in (0, 1)]
        if abs(new - share) < 1e-7:
            break
        share = new
    return share, says


def posterior(votes: tuple[int, ...], share: float, says: list[list[dict[int, float]]]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(says[1][r][v] / says[0][r][v]) for r, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def _votes(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f"v_{n}": vote(n).cast("tinyint") for n in RULES})


def _model(stats: DataFrame) -> tuple[float, list[list[dict[int, float]]]]:
    """What EM learns from the vote patterns, at most 3 ** rules rows."""
    counted = stats.groupBy(*(f"v_{n}" for n in RULES)).count().collect()
    return fit(sorted((tuple(r[:-1]), r["count"]) for r in counted))


def _judged(stats: DataFrame, model: tuple[float, list[list[dict[int, float]]]], threshold: float) -> DataFrame:
    share, says = model
    odds = F.lit(math.log(share / (1 - share)))
    for r, n in enumerate(RULES):
        weight = {v: math.log(says[1][r][v] / says[0][r][v]) for v in (1, 0, -1)}
        odds = odds + F.when(F.col(f"v_{n}") == 1, weight[1]).when(F.col(f"v_{n}") == -1, weight[-1]).otherwise(weight[0])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, p_good and kept, one row for each row of ``docs``."""
    stats = Scratch(docs.sparkSession, "rules").save(_votes(statistics(docs)), "stats")
    return _judged(stats, _model(stats), threshold)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, all columns.

    Rows are written once with their votes: the statistics are by far the
    dearest part, and nothing is shuffled to bring them back to the texts.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    voted = _votes(statistics(whole, "_row")).select("_row", "n_words", "n_repeat_words", *(f"v_{n}" for n in RULES))
    voted = Scratch(docs.sparkSession, "rules").save(voted, "voted")
    return _judged(voted, _model(voted), threshold).where("kept").select("_row.*")


def op10(docs: DataFrame) -> DataFrame:
    scored = quality_rules(docs)
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"]
    out = scored.select(*keep)
    return out
