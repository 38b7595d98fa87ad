"""Quality rules with a distribution-divergence check, in SQL expressions only.

A text's words are runs of characters other than space and 0x09 to 0x0D. The base rule rejects texts that are
short or repeat themselves. The method compares two histograms of a text with references of each language by
the Jensen-Shannon distance (base two, so between 0 and 1): character classes, and common words plus one bin
for all others. A text is rejected if it is far from every language in either histogram. The common-word check
needs MIN_WORDS words and the class check MIN_CHARS characters; below that the histogram is noise and the check passes.

The references of words are those of Zipf's law: the word of rank r of a language has a share of ZIPF / r, with the constant of the
classical count of English running text ("the": 7 %), and the ranks are those of the published lists of RANKED. Seven languages are known; a text of
any other language is rejected by the common-word check unless ``references`` names its words too. The limits are set by what the
distances mean, not by a corpus: a text with none of the words of any language lies at a fixed distance from all of them (0.32), and nine tenths of it is
the limit. Prose lies within 0.1 of the class reference, tables, code and shouting beyond 0.2; the limit lies half way. Both limits are parameters.
The language column is never read.

Windows of three words are compared by 64-bit hashes within one text: two different ones of a text of n words are taken for equal with
a chance below n * n / 2 ** 65.

Everything is one projection over the row: no shuffle, nothing gathered. Nulls: a null text has no words
and fails the base rule. Empty and very long texts follow the same expressions; repeated rows and ties are judged alike; an empty
table gives an empty result. Extra columns are kept, whatever their names, except one named like the result (``into``), which the result replaces.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, quoted

SYMBOLS = "#*$%&|<>"
#: Character classes as regular expressions; spaces and "other" are what is left. Digits are "other": a number or
#: an address in a short clean text would else weigh as much as junk.
UPPER, POINT, SYMBOL = "\\p{Lu}", "[.,;:!?'\"()-]", f"[{SYMBOLS}]"
#: Shares of upper case, spaces, points, symbols and other in running text.
CLASS_REFERENCE = (0.016, 0.162, 0.025, 0.0005, 0.7965)
#: Share of the most common word by Zipf's law.
ZIPF = 0.07
#: The most common words of languages by rank in published counts (English: books of the 20th century, German:
#: newspapers, Spanish: the Academy's reference corpus, others: newspapers and books).
RANKED: Mapping[str, str] = {
    "de": "der die und in den von zu das",
    "en": "the of and to in a is that",
    "es": "de la que el en y a los",
    "fr": "de la le et les des en un",
    "it": "di e che la il un a per",
    "nl": "de van het een en in is dat",
    "pt": "de a o que e do da em",
}


def zipf(ranked: Mapping[str, str], first: float = ZIPF) -> dict[str, dict[str, float]]:
    """Shares of ranked words by Zipf's law."""
    return {language: {w: round(first / (r + 1), 6) for r, w in enumerate(words.split())} for language, words in ranked.items()}


#: Shares of the most common words in running text, by language.
WORD_REFERENCES: Mapping[str, Mapping[str, float]] = zipf(RANKED)
#: Marks that may follow a common word in running text.
MARKS = ".,"
#: Least words and characters for a histogram to say anything.
MIN_WORDS = 50
MIN_CHARS = 200
MAX_CLASS_DISTANCE = 0.15
#: Of the distance of a text without any of the words.
MAX_WORD_DISTANCE = 0.29


def jensen_shannon(shares: list[Column], reference: list[float]) -> Column:
    """The Jensen-Shannon distance, base two, of a histogram from a reference with the same bins."""

    def part(p: Column, q: float) -> Column:
        m = (p + q) / 2
        own = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
        return own + (q * F.log2(F.lit(q) / m) if q > 0 else 0.0)

    total = F.lit(0.0)
    for p, q in zip(shares, reference):
        total = total + part(p, q)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def word_bins(references: Mapping[str, Mapping[str, float]]) -> list[str]:
    return sorted({w for words in references.values() for w in words})


def spellings(words: list[str]) -> list[str]:
    """The forms in which a common word counts: lower case or capitalised, plain or before a mark."""
    return [f + m for w in words for f in dict.fromkeys((w, w[:1].upper() + w[1:])) for m in ("", *MARKS)]


def occurrences(words: str, word: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, word))


def covered_by_repeats(grams: str) -> Column:
    """Words covered by three-word windows that occur twice or more; ``grams``: a column of window hashes by position."""
    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # the sorted array is bound once, as a lambda variable
    marked = F.flatten(
        F.transform(
            F.array(ordered),
            lambda a: F.transform(
                F.filter(a, lambda x, j: (x["h"] == F.get(a, j - 1)["h"]) | (x["h"] == F.get(a, j + 1)["h"])),
                lambda x: x["i"],
            ),
        )
    )
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    fold = F.aggregate(F.sort_array(marked), start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(fold["n"])


def judge(docs: DataFrame, *, text_col: str = "text", into: str = "rules", references: Mapping[str, Mapping[str, float]] = WORD_REFERENCES, class_reference: tuple[float, ...] = CLASS_REFERENCE, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept.

    A distance is null where its minimum-length guard holds; a null distance passes.
    """
    bins = word_bins(references)
    # the caller's columns go under names of their own, so that none is taken for one of those below
    held = {c: f"c{i}" for i, c in enumerate(docs.columns) if c.lower() != into.lower()}
    own = list(held.values())
    step = docs.select(*[F.col(quoted(c)).alias(k) for c, k in held.items()], F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("t"))
    step = step.withColumn("w", F.array_remove(F.split("t", f"[{SPACES}]+"), ""))
    grams = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    common = F.transform(F.filter("w", lambda w: w.isin(spellings(bins))), lambda w: F.lower(F.rtrim(w, F.lit(MARKS))))
    step = step.select(
        *own,
        F.size("w").cast("long").alias("n"),
        F.char_length("t").cast("long").alias("len"),
        F.char_length(F.array_join("w", "")).cast("long").alias("chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("sym"),
        F.regexp_count("t", F.lit(UPPER)).cast("long").alias("up"),
        F.regexp_count("t", F.lit(POINT)).cast("long").alias("pt"),
        lines.alias("lines"),
        grams.alias("grams"),
        common.alias("common"),
    )
    step = step.withColumn("rep", covered_by_repeats("grams")).withColumn("dup", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    step = step.withColumn("bins", F.struct(*[occurrences("common", w).alias(f"b{i}") for i, w in enumerate(bins)]))
    of = lambda c: F.col(c) / F.col("len")
    rest = F.col("chars") - F.col("up") - F.col("pt") - F.col("sym")
    shares = [of("up"), (F.col("len") - F.col("chars")) / F.col("len"), of("pt"), of("sym"), rest / F.col("len")]
    class_distance = F.when(F.col("len") >= MIN_CHARS, jensen_shannon(shares, list(class_reference)))
    by_language = []
    for words in references.values():
        counts = {w: F.col("bins")[f"b{bins.index(w)}"] for w in words}
        known = F.lit(0)
        for c in counts.values():
            known = known + c
        by_language.append(jensen_shannon([*(c / F.col("n") for c in counts.values()), (F.col("n") - known) / F.col("n")], [*words.values(), 1 - sum(words.values())]))
    word_distance = F.when(F.col("n") >= MIN_WORDS, F.least(*by_language) if len(by_language) > 1 else by_language[0])
    failed = (F.col("n") < 50) | (100 * F.col("rep") > 50 * F.col("n"))
    step = step.withColumn("cd", class_distance).withColumn("wd", word_distance).withColumn("bad", failed)
    kept = ~F.col("bad") & (F.coalesce("cd", F.lit(0.0)) <= max_class_distance) & (F.coalesce("wd", F.lit(0.0)) <= max_word_distance)
    rules = F.struct(
        F.col("n").alias("n_words"), F.col("chars").alias("word_chars"), F.col("sym").alias("n_symbols"), F.col("dup").alias("n_dup_lines"), F.col("rep").alias("n_repeat_words"),
        F.col("bad").alias("base_failed"), F.col("cd").alias("class_distance"), F.col("wd").alias("word_distance"), kept.alias("kept"),
    )
    # a generator bars a later filter on the verdict from being pushed down, where it would be computed many times over
    judged = step.select(*own, F.explode(F.array(rules)).alias("found"))
    return judged.select(*[F.col(k).alias(c) for c, k in held.items()], F.col("found").alias(into))
