"""Quality rules as a short-circuit cascade, in SQL functions only.

Each rule is a predicate that rejects. Its cost is estimated from a sample: every measure has
a work factor (passes over the text's characters or words), and a rule costs the factors of
its measures times the sample's mean sizes. Its rejection rate is counted on the same sample,
all rules in one pass. The cascade asks the rules in order of rejections per cost: one CASE
expression, which stops at the first rule that rejects, so later and dearer rules run on few
documents. The estimate doesn't depend on the machine's load, so the same input always gives
the same order. The order changes the cost and the name of the rule that is reported, never
the verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _with(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words in windows of ``width`` words that the text has twice or more.

    Windows are compared by a 64-bit hash. Texts without a repeat are told by a set; only the
    others sort their windows.
    """

    def windows(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.slice(w, i, width)))
        return F.when(F.size(w) < width, F.array().cast("array<bigint>")).otherwise(made)

    def starts(z: Column) -> Column:
        """Positions of repeated windows, rising; z: sorted (hash, position)."""
        twice = F.transform(z, lambda x, i: F.when(x["h"].eqNullSafe(F.get(z, i - 1)["h"]) | x["h"].eqNullSafe(F.get(z, i + 1)["h"]), x["i"]))
        return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

    def covered(d: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            return F.struct((i + width).alias("end"), (a["n"] + i + width - F.greatest(a["end"], i)).alias("n"))

        return F.aggregate(d, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add, lambda a: a["n"].cast("long"))

    def count(w: Column) -> Column:
        order = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_with(order, lambda z: covered(starts(z))))

    # Bound once: a lambda that named the words' own expression would split the text for each window.
    return _with(words, lambda w: _with(windows(w), count))


@dataclass(frozen=True)
class Measures:
    """Columns that rules are made of."""

    text: Column
    words: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column

    @classmethod
    def of(cls, text: Column, words: Column) -> Measures:
        """Expressions, each computed only where a rule asks for it."""
        return cls(text, words, F.size(words).cast("long"), F.length(F.array_join(words, "")).cast("long"), symbols(text), duplicate_lines(text), repeated_words(words))


@dataclass(frozen=True)
class Rule:
    """``chars`` and ``words``: passes over the text's characters and its words that it takes."""

    name: str
    rejects: Callable[[Measures], Column]
    chars: float = 0.0
    words: float = 0.0


def _letters(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.regexp_count(text, F.lit(pattern))


BASE = (
    Rule("few_words", lambda m: m.n_words < 10),
    Rule("repeats", lambda m: 100 * m.n_repeat_words > 20 * m.n_words, words=30),
)
RULES = (
    Rule("symbols", lambda m: m.n_symbols > m.n_words, chars=2),
    Rule("same_lines", lambda m: (m.n_dup_lines >= 3) & (m.n_dup_lines * 10 > 3 * F.size(F.split(m.text, "\n"))), chars=2),
    Rule("long_words", lambda m: m.word_chars > 25 * m.n_words, chars=1, words=1),
    Rule("short_words", lambda m: m.word_chars < 2 * m.n_words, chars=1, words=1),
    Rule("capitals", lambda m: _letters("[A-Z]")(m.text) > _letters("[a-z]")(m.text), chars=4),
    Rule("no_letters", lambda m: 2 * _letters(r"\p{L}")(m.text) < F.length(m.text), chars=3),
)


def prepared(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep``, and the text (null: empty) and its words as __t and __w."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(*keep, text.alias("__t")).withColumn("__w", words_of(F.col("__t")))


def plan(docs: DataFrame, rules: tuple[Rule, ...], *, id_col: str = "doc_id", text_col: str = "text", rows: int = 1_000) -> list[Rule]:
    """The rules by rejections per cost on a sample of ``rows`` documents of least id hash.

    Null and empty texts count as texts without words; rows that repeat a sampled id count as
    often as they are there. Of an empty table, all rules have the same rate.
    """
    own = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__s"))
    picked = own.select("__i").orderBy(F.xxhash64("__i"), "__i").limit(rows).distinct()
    some = own.join(F.broadcast(picked), "__i", "left_semi")  # at most ``rows`` ids
    m = Measures.of(F.col("__t"), F.col("__w"))
    hits = [F.coalesce(F.sum(r.rejects(m).cast("int")), F.lit(0)) for r in rules]
    chars, words, n, *hit = prepared(some, "__s", []).agg(F.coalesce(F.avg(F.length("__t")), F.lit(0.0)), F.coalesce(F.avg(F.size("__w")), F.lit(0.0)), F.count("*"), *hits).first()
    rank = {r.name: -(h + 1) / (n + 2) / (1 + r.chars * chars + r.words * words) for r, h in zip(rules, hit, strict=True)}
    return sorted(rules, key=lambda r: (rank[r.name], r.name))


def cascade(rules: list[Rule], m: Measures) -> Column:
    """Name of the first rule that rejects, else null."""
    return reduce(lambda c, r: c.when(r.rejects(m), F.lit(r.name)), rules, F.when(F.lit(False), F.lit("")))


def judge(docs: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, the measures, base_failed, kept and rejected_by.

    Null and empty texts have no words and fail the base rules. Nothing is shuffled.
    """
    m = Measures.of(F.col("__t"), F.col("__w"))
    told = prepared(docs, text_col, [F.col(id_col)]).select(
        id_col, "__t", "__w", m.n_words.alias("n_words"), m.word_chars.alias("word_chars"), m.n_symbols.alias("n_symbols"), m.n_dup_lines.alias("n_dup_lines"), m.n_repeat_words.alias("n_repeat_words")
    )
    known = Measures(*map(F.col, ("__t", "__w", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))
    base = reduce(lambda a, b: a | b, (r.rejects(known) for r in BASE))
    more = [r for r in rules if r not in BASE]
    out = told.withColumn("base_failed", base)
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(more, known)))
    return out.withColumn("kept", F.col("rejected_by").isNull()).drop("__t", "__w")


def keep(docs: DataFrame, rules: list[Rule], *, text_col: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns; the cascade alone runs."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(text_col).alias("__s"))
    told = prepared(rows, "__s", [F.col("__row")])
    return told.where(cascade(rules, Measures.of(F.col("__t"), F.col("__w"))).isNull()).select("__row.*")
