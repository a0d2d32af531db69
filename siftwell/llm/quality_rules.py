"""Quality rules: a threshold table compiled into one projection.

Every measure is an expression over the whole text of the row, every rule a
comparison of integers; nothing is shuffled, joined or run in Python.

Null text counts as an empty one (no words: the base fails). Rows are judged
one by one, so ties and repeated rows need no rule and give equal results; an
empty table gives an empty table. Other columns of the input are not read and
may have any name. Window keys are 64-bit hashes compared within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siftwell.llm.shared import SPACES, text_or_empty

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for on as with was by this are be or at it an "
    "le la les de des et en un une que qui dans pour par sur du au avec "
    "der die das und ist ein eine von mit zu den auf im nicht für "
    "el los las y una del por con para su al se es"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * measure / per <= high``; a bound of None is open, ``per`` None means 1/100."""

    name: str
    measure: str
    per: str | None
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("enough_words", "n_words", None, low=20),
    Rule("repeated_words", "n_repeat_words", "n_words", high=30),
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("exclamations", "n_exclamations", "n_words", high=25),
    Rule("stop_words", "n_stop_words", "n_words", low=3),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=60),
    Rule("echoed_words", "n_echo_words", "n_words", high=30),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=30),
)
#: Rules that make up ``base_failed``.
BASE = ("enough_words", "repeated_words")


def _without(chars: str, text: Column) -> Column:
    return F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id and every measure that rules may name (long)."""
    none = F.array().cast("array<string>")
    text = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("t"))
    parts = text.select(
        "id",
        "t",
        F.btrim("t", F.lit(SPACES)).alias("core"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
    )
    words = parts.select(
        "*", F.when(F.col("core") == "", none).otherwise(F.split("core", BLANK)).alias("words")
    )
    hashed = words.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))

    def window(i: Column) -> Column:
        return F.xxhash64(*(F.col("h")[i + j] for j in range(WINDOW)))

    starts = F.sequence(F.lit(0), F.size("words") - WINDOW)
    keyed = hashed.select(
        "*",
        F.when(F.size("words") >= WINDOW, F.transform(starts, window))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("keys"),
    )
    # Most texts repeat no window; only the others sort theirs.
    ordered = keyed.select(
        "*",
        F.when(
            F.size(F.array_distinct("keys")) < F.size("keys"),
            F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
        ).alias("o"),
    )

    def repeats(x: Column, i: Column) -> Column:
        o, last = F.col("o"), F.size("o") - 1
        before = (i > 0) & (o[F.greatest(i - 1, F.lit(0))]["k"] == x["k"])
        after = (i < last) & (o[F.least(i + 1, last)]["k"] == x["k"])
        return before | after

    found = ordered.select(
        "*",
        F.sort_array(F.transform(F.filter("o", repeats), lambda x: x["i"])).alias("p"),
    )

    def fresh(x: Column, i: Column) -> Column:
        """Words that the window at x covers before the next repeated window starts."""
        p, last = F.col("p"), F.size("p") - 1
        step = F.when(i < last, p[F.least(i + 1, last)] - x).otherwise(WINDOW)
        return F.least(step, F.lit(WINDOW))

    covered = F.aggregate(F.transform("p", fresh), F.lit(0), lambda a, x: a + x)
    stops = F.filter("words", lambda w: w.isin(*_cased(STOP_WORDS)))
    echoes = F.filter("words", lambda w, i: (i > 0) & (F.col("words")[F.greatest(i - 1, F.lit(0))] == w))
    whole = F.length("t")
    long_values = {
        "n_words": F.size("words"),
        "word_chars": _without(SPACES, F.col("t")),
        "n_symbols": whole - _without(SYMBOLS, F.col("t")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("lines"),
        "n_cut_lines": F.size(F.filter("lines", lambda x: x.endswith("...") | x.endswith("…"))),
        "n_stop_words": F.size(stops),
        "n_echo_words": F.size(echoes),
        "n_exclamations": whole - _without("!", F.col("t")),
    }
    return found.select(
        F.col("id").alias(id_column), *(v.cast("long").alias(k) for k, v in long_values.items())
    )


def _cased(words: list[str]) -> list[str]:
    return [*words, *(w[0].upper() + w[1:] for w in words)]


def passes(rule: Rule) -> Column:
    value = F.col(rule.measure) * (100 if rule.per else 1)
    unit = F.col(rule.per) if rule.per else F.lit(1)
    checks = [] if rule.low is None else [value >= unit * rule.low]
    checks += [] if rule.high is None else [value <= unit * rule.high]
    result = F.lit(True)
    for check in checks:
        result = result & check
    return result


def quality_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    base: tuple[str, ...] = BASE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Measures, ``failed`` (names of the rules that a document breaks), ``base_failed``, ``kept``."""
    broken = F.array_compact(F.array(*(F.when(~passes(r), F.lit(r.name)) for r in rules)))
    judged = measures(docs, id_column, text_column).withColumn("failed", broken)
    in_base = F.arrays_overlap("failed", F.array(*(F.lit(x) for x in base)))
    return judged.withColumns({"base_failed": in_base, "kept": F.size("failed") == 0})


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from siftwell.llm.shared import table

    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_passes(rule: Rule) -> str:
    value, unit = (f"100 * {rule.measure}", rule.per) if rule.per else (rule.measure, "1")
    low = f"{value} >= {rule.low} * {unit}" if rule.low is not None else "true"
    high = f"{value} <= {rule.high} * {unit}" if rule.high is not None else "true"
    return f"({low} and {high})"


OP1_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), w as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
    [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as ls
  from d
), win as (
  select r, i, array_to_string(ws[i:i + 7], ' ') as k
  from (select r, ws, unnest(range(1, greatest(len(ws) - 6, 1))) as i from w)
), rep as (
  select r, i from (select r, i, count(*) over (partition by r, k) as c from win) where c > 1
), cov as (
  select r, sum(least(8, n - i)) as n_repeat_words
  from (select r, i, coalesce(lead(i) over (partition by r order by i), i + 8) as n from rep)
  group by r
), m as (
  select doc_id, len(ws)::bigint as n_words,
    coalesce(length(array_to_string(ws, '')), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(ls)::bigint as n_lines,
    len([x for x in ls if x like '%...' or x like '%…'])::bigint as n_cut_lines,
    len([x for x in ws if list_contains({_sql_list(_cased(STOP_WORDS))}, x)])::bigint as n_stop_words,
    len([i for i in range(2, len(ws) + 1) if ws[i] = ws[i - 1]])::bigint as n_echo_words,
    length(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_exclamations
  from w left join cov using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  not ({" and ".join(_sql_passes(r) for r in RULES if r.name in BASE)}) as base_failed,
  {" and ".join(_sql_passes(r) for r in RULES)} as kept
from m
"""
