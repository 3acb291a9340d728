"""Quality rules that vote, weighed by weak supervision, by functions of Spark only.

Each rule says of a text that it is bad, that it is good, or nothing. Nobody says which rules are right: the texts do. A
text is good or bad, unseen; given that, the rules vote independently, each with its own chances of either vote among
good and among bad texts (its accuracies). Expectation-maximisation finds these chances and the share of good texts from
the votes of all texts, and a text is kept by its probability to be good given its votes, not by passing every rule.

Texts are read once, each by itself, into numbers and a pattern of votes, one letter a rule. Texts of one pattern are
alike for the model, so they are counted first: at most 3 ** (number of rules) patterns, whatever the corpus, and an
iteration is one aggregate over the counted patterns, of which the driver sees three sums a rule. Nothing else is
shuffled; no text is, and no group of texts is gathered.

Repeated windows of ``WINDOW`` words are found inside the row: hashes of words are doubled to hashes of 2, 4 and 8, sorted
only where a text has two equal ones, and the words that these windows cover are counted along their sorted places. Windows
count as equal when their 64-bit hashes of hashes are. What a text needs while it is read grows with its own words.

Defined cases: null counts as empty; a text without words fails the base rules; rows are independent, so repeated rows and
rows that share an id get the same result; an empty table gives an empty result; where all texts vote alike, that
pattern's probability decides for all; only the id and the text are read, other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import saved, whole

# ---- fixed values of the base rules ----
SPACE = "[\\x20\\x09-\\x0D]+"
HAS_WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
# ---- end of fixed values ----

#: frequent short words of four languages; prose has them in every language here, lists and noise in none
FUNCTION_WORDS = (
    "the of and to in a is that for was on with as it be at by this from are or an "
    "de la le et les des un une en du que est pour dans par sur qui "
    "der die und den von zu das mit dem ein eine nicht ist im auf für "
    "el los las y se por con para del no una su al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """SQL over the numbers of a text: where it is bad and where it is good; elsewhere, and on NULL, the rule abstains."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), "b").when(F.expr(self.good), "g").otherwise("-")


RULES = (
    Rule("length", f"n_words < {LEAST_WORDS}", "n_words >= 50"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "n_words >= 20 AND 100 * n_repeat_words <= 5 * n_words"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "n_lines > 1 AND n_dup_lines = 0"),
    Rule("symbols", "10 * n_symbols > n_words", "n_words > 0 AND 100 * n_symbols <= n_words"),
    Rule("word_size", "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)", "word_chars BETWEEN 4 * n_words AND 8 * n_words"),
    Rule("capitals", "n_letters >= 50 AND 10 * n_upper > 4 * n_letters", "n_letters >= 50 AND 10 * n_upper < n_letters"),
    Rule("letters", "100 * n_letters < 80 * word_chars", "n_words > 0 AND 100 * n_letters >= 90 * word_chars"),
    Rule("function_words", "n_words >= 50 AND 100 * n_function_words < n_words", "n_words > 0 AND 100 * n_function_words >= 8 * n_words"),
    Rule("distinct", "n_words >= 50 AND n_distinct * n_distinct < 4 * n_words", "n_words >= 50 AND n_distinct * n_distinct > 20 * n_words"),
    Rule("exclamations", "10 * n_exclamations > 3 * n_words", "n_words > 0 AND 100 * n_exclamations <= 5 * n_words"),
    Rule("lone_marks", "10 * n_lone_marks > n_words", "n_words > 0 AND 100 * n_lone_marks <= 2 * n_words"),
    Rule("sentences", "n_words >= 50 AND (n_ends = 0 OR 2 * n_ends > n_words)", "n_ends > 0 AND 100 * n_ends BETWEEN n_words AND 35 * n_words"),
)


@dataclass(frozen=True)
class Settings:
    rounds: int = 30
    least: float = 0.5  # probability of a good text that is enough
    # What is believed before any text: the share of bad texts; of bad and of good texts, how many a rule calls bad.
    bad_share: float = 0.2
    hit_bad: float = 0.3
    hit_good: float = 0.02
    abstain: float = 0.1
    weight: float = 2.0  # texts of each kind that this belief counts as


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _behind(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _windows(words: Column) -> Column:
    """The hash of every window of ``WINDOW`` words, in order. Doubled: of 2 words, of 4, of 8."""
    if WINDOW != 8:
        raise ValueError("windows are doubled three times")

    def doubled(hashes: Column, by: int, use: Callable[[Column], Column]) -> Column:
        return _let(F.zip_with(hashes, _behind(hashes, by), lambda x, y: F.xxhash64(x, y)), use)

    full = F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))
    of_one = F.transform(words, lambda x: F.xxhash64(x))
    return _let(of_one, lambda h: doubled(h, 1, lambda h2: doubled(h2, 2, lambda h4: doubled(h4, 4, lambda h8: F.slice(h8, 1, full)))))


def _repeated_words(words: Column) -> Column:
    """Words in windows that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # Equal windows stand side by side; each pair of neighbours gives both its places.
        pairs = _let(placed, lambda s: F.zip_with(s, _behind(s, 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))))
        places = F.sort_array(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda s, p: F.struct((s["n"] + F.least(p - s["last"], F.lit(WINDOW))).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda s: s["n"])

    return _let(_windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def _of_class(text: Column, pattern: str) -> Column:
    """Characters in runs of a class."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _without(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def numbers(text: Column) -> Column:
    """What the rules look at, as one struct of longs."""
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(HAS_WORD)))

    def having(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda a: F.size(F.filter(a, test))

    of_words = {
        "n_words": F.size,
        "word_chars": lambda w: F.char_length(F.array_join(w, "")),
        "n_repeat_words": _repeated_words,
        "n_distinct": lambda w: F.size(F.array_distinct(w)),
        "n_function_words": having(lambda x: F.lower(x).isin(FUNCTION_WORDS)),
        "n_lone_marks": having(lambda x: ~F.rlike(x, F.lit("[\\p{L}\\p{N}]"))),
        "n_ends": having(lambda x: F.right(x, F.lit(1)).isin(".", "!", "?")),
    }
    of_lines = {"n_lines": F.size, "n_dup_lines": lambda a: F.size(a) - F.size(F.array_distinct(a))}
    of_text = {
        "n_symbols": _without(text, SYMBOLS),
        "n_exclamations": _without(text, "!?"),
        "n_letters": _of_class(text, "\\p{L}+"),
        "n_upper": _of_class(text, "\\p{Lu}+"),
    }

    def long(value: Column, name: str) -> Column:
        return value.cast("long").alias(name)

    return _let(
        words,
        lambda w: _let(
            lines,
            lambda a: F.struct(
                *(long(f(w), name) for name, f in of_words.items()), *(long(f(a), name) for name, f in of_lines.items()), *(long(c, name) for name, c in of_text.items())
            ),
        ),
    )


# ---- the model of the votes ----
VOTES = "bg-"


@dataclass(frozen=True)
class Belief:
    """The share of bad texts, and of bad and of good texts by rule, how many a rule calls bad, calls good, and leaves."""

    bad_share: float
    bad: list[list[float]]
    good: list[list[float]]


def first_belief(n_rules: int, s: Settings) -> Belief:
    bad, good = ([hit * (1 - s.abstain), (1 - hit) * (1 - s.abstain), s.abstain] for hit in (s.hit_bad, s.hit_good))
    return Belief(s.bad_share, [bad] * n_rules, [good] * n_rules)


def _slots(votes: Column, n_rules: int) -> Column:
    """The pattern as places in a list of all rules' votes: rule by rule, in the order of ``VOTES``."""
    return F.array(*(F.instr(F.lit(VOTES), F.substring(votes, j + 1, 1)) + (3 * j - 1) for j in range(n_rules)))


def good_probability(slots: Column, belief: Belief) -> Column:
    """The probability of a good text given its votes. What the votes say is one array of constants, so the plan is the
    same, and compiled once, for every belief."""
    say = F.array(*(F.lit(math.log(g / b)) for good, bad in zip(belief.good, belief.bad, strict=True) for g, b in zip(good, bad, strict=True)))
    start = F.array(F.lit(math.log((1 - belief.bad_share) / belief.bad_share)))[0]
    return 1 / (1 + F.exp(-F.aggregate(slots, start, lambda odds, i: odds + say[i])))


def learn(patterns: DataFrame, n_rules: int, settings: Settings = Settings()) -> Belief:
    """What ``settings.rounds`` iterations find from ``(votes, n)``. The first belief counts as ``weight`` texts of either
    kind, so no chance is 0 and bad stays bad. The patterns, bounded in number whatever the corpus, are one partition."""
    belief = first = first_belief(n_rules, settings)
    slotted = patterns.select(_slots(F.col("votes"), n_rules).alias("slots"), F.col("n").cast("double")).coalesce(1)
    for _ in range(settings.rounds):
        read = slotted.select(F.explode("slots").alias("slot"), "n", (F.col("n") * good_probability(F.col("slots"), belief)).alias("good"))
        found = {r.slot: r for r in read.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()}
        if not found:
            return belief
        good = [found[k].good if k in found else 0.0 for k in range(3 * n_rules)]
        bad = [found[k].n - found[k].good if k in found else 0.0 for k in range(3 * n_rules)]
        belief = _next_belief(bad, good, first, settings.weight)
    return belief


def _next_belief(bad: list[float], good: list[float], first: Belief, weight: float) -> Belief:
    def chances(own: list[float], believed: list[list[float]]) -> list[list[float]]:
        total = sum(own[:3]) + weight
        return [[(own[3 * j + k] + weight * c) / total for k, c in enumerate(rule)] for j, rule in enumerate(believed)]

    texts = sum(bad[:3]) + sum(good[:3])
    return Belief((sum(bad[:3]) + weight * first.bad_share) / (texts + weight), chances(bad, first.bad), chances(good, first.good))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, settings: Settings = Settings()
) -> DataFrame:
    """One row per row of ``docs``: the id, the numbers of the text, ``votes`` (b, g or - for each rule), ``quality``, the
    probability of a good text, ``base_failed`` and ``kept``."""
    read = docs.select(F.col(f"`{id_col}`").alias("_id"), numbers(whole(f"`{text_col}`")).alias("_numbers")).select("_id", "_numbers.*")
    voted = saved(read.withColumn("votes", F.concat(*(r.vote() for r in rules))))
    patterns = saved(voted.groupBy("votes").agg(F.count("*").alias("n")))
    belief = learn(patterns, len(rules), settings)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    quality = good_probability(_slots(F.col("votes"), len(rules)), belief)
    out = voted.withColumn("quality", quality).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= settings.least)).withColumnRenamed("_id", id_col)
