"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure of a document is a built-in expression over its whole text, and every rule is a row of ``RULES``: a
measure, the side on which it fails and a limit. ``measure`` adds the measures as one struct, ``judge`` compiles the
table on top. There is no shuffle, no join and no user function; a document is one row from the scan to the result.

Edge cases: a null text counts as empty (no words; it fails ``too_few_words``); copies are judged alike; an empty
table gives no rows; columns other than the named ones take no part, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACES, WORD, let

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the languages handled, lower case.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this at an from or "
    "le la les de des du et un une en que qui est pour dans au aux par sur ne pas il elle "
    "der die das und den dem ein eine von zu mit ist auf nicht sich als im auch "
    "el los las y del una por con no se su para al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` (a name of ``measure``'s struct, or a ratio of two) fails below ``least`` or above ``most``."""

    name: str
    measure: str
    per: str | None = None
    least: float | None = None
    most: float | None = None
    #: The rule speaks only of documents with at least this many words.
    from_words: int = 0
    base: bool = False


RULES = (
    Rule("too_few_words", "n_words", least=20, base=True),
    Rule("repeated_words", "n_repeat_words", per="n_words", most=0.30, base=True),
    Rule("long_words", "word_chars", per="n_words", most=40),
    Rule("symbols", "n_symbols", per="n_words", most=0.20),
    Rule("repeated_lines", "n_dup_lines", per="n_lines", most=0.50),
    Rule("no_stop_words", "n_stop_words", per="n_words", least=0.005, from_words=100),
)


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``hashes``: one per window, in order."""

    def covered(ordered: Column) -> Column:
        def same(other: Column, one: Column) -> Column:
            return F.coalesce(other["h"] == one["h"], F.lit(False))

        twice = F.filter(ordered, lambda e, k: same(F.get(ordered, k - 1), e) | same(F.get(ordered, k + 1), e))
        at = F.sort_array(F.transform(twice, lambda e: e["at"]))
        # A window covers what lies before the next one, eight words at most.
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda here, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - here, F.lit(WINDOW)))),
            F.lit(0), lambda total, n: total + n))

    pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))


def measure(text: Column) -> Column:
    """Struct of all measures of a text.

    n_words, word_chars, n_symbols, n_repeat_words: words of ``WORD``, their code points, characters of ``SYMBOLS``,
    words inside a repeated 8-word window. n_lines, n_dup_lines: \\n-split lines with a word, and those equal to an
    earlier one. n_stop_words: words that are stop words once lower-cased and freed of punctuation at the end.
    Windows are told apart by the 64-bit hash of their words.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of_words(w: Column) -> Column:
        hashes = F.when(F.size(w) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(1))),
            lambda at: F.xxhash64(F.slice(w, at, WINDOW))))
        stop = F.filter(w, lambda word: F.rtrim(F.lower(word), F.lit(".,;:!?")).isin(STOP_WORDS))
        return F.struct(F.size(w).cast("long").alias("n"), let(hashes, _repeat_words).cast("long").alias("repeat"),
                        F.size(stop).cast("long").alias("stop"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"),
                        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

    return let(F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l")), lambda m: F.struct(
        m["w"]["n"].alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        m["l"]["n"].alias("n_lines"), m["l"]["dup"].alias("n_dup_lines"),
        m["w"]["repeat"].alias("n_repeat_words"),
        m["w"]["stop"].alias("n_stop_words")))


def failed(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules a document with the measures ``m`` fails."""
    def broken(rule: Rule) -> Column:
        value, unit = m[rule.measure], m[rule.per] if rule.per else F.lit(1)
        outside = [value < F.lit(rule.least) * unit] if rule.least is not None else []
        outside += [value > F.lit(rule.most) * unit] if rule.most is not None else []
        fails = outside[0] if len(outside) == 1 else outside[0] | outside[1]
        return F.when(fails & (m["n_words"] >= rule.from_words), F.lit(rule.name))

    return F.array_compact(F.array(*map(broken, rules)))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the structs ``_quality`` (measures) and ``_failed`` (names of failed rules).

    Input columns of these names are replaced.
    """
    judged = docs.withColumn("_quality", measure(F.col(text)))
    return judged.withColumn("_failed", failed(F.col("_quality"), rules))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that fail no rule, with their own columns."""
    return docs.where(let(measure(docs["text"]), lambda m: F.size(failed(m, rules)) == 0))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed and kept, then n_lines, n_stop_words and the failed rules' names."""
    base = tuple(rule for rule in RULES if rule.base)
    out = judge(docs.select("doc_id", "text"))
    m = F.col("_quality")
    # Integers: 100 * n_repeat_words > 30 * n_words.
    base_failed = (m["n_words"] < base[0].least) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    return out.select(
        "doc_id", *[m[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed.alias("base_failed"), (~base_failed & (F.size("_failed") == 0)).alias("kept"),
        m["n_lines"].alias("n_lines"), m["n_stop_words"].alias("n_stop_words"),
        F.concat_ws(",", "_failed").alias("failed_rules"))
