"""Operator 6, quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import SPACE, quoted, table

#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = tuple(
    "the of and to in a is it for on with as by at be this that are not from was or an have has but which you we they "
    "le la de et les des un une en que qui par pour au du ou dans ce se sur avec est pas plus il elle "
    "der die das und den von mit zu ist ein auf im nicht dem eine sich des als auch es an werden aus er hat "
    "el los las y por con para al lo como su del una más".split()
)


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [low, high]; rules over ratios hold only for texts of at_least words."""

    name: str
    measure: str
    low: float = float("-inf")
    high: float = float("inf")
    at_least: int = 0


#: Production thresholds. base_failed covers the contract's length and repetition rules; these come on top.
RULES = (
    Rule("mean word length", "mean_word", 2.5, 12.0),
    Rule("symbols a word", "symbol_ratio", high=0.1),
    Rule("stop words a word", "stop_ratio", low=0.03),
    Rule("words with a letter", "alpha_ratio", low=0.7),
    Rule("upper-case characters", "upper_ratio", high=0.4),
    Rule("repeated lines", "dup_line_ratio", high=0.3),
    Rule("bullet lines", "bullet_ratio", high=0.9),
    Rule("lines that end in an ellipsis", "ellipsis_ratio", high=0.3),
)

_WINDOW = 3


def _words(text: Column) -> Column:
    edge = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(edge == "", F.array().cast("array<string>")).otherwise(F.split(edge, f"[{SPACE}]+"))


def _whole_words(text: Column, pattern: str) -> Column:
    """Number of words that match pattern from end to end; tried behind white space alone, so linear in the text."""
    return F.regexp_count(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f"[{SPACE}](?:{pattern})(?=[{SPACE}])"))


def _any_of(words: tuple[str, ...]) -> str:
    """A pattern for the words that branches on their first letters."""
    first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        first.setdefault(w[0], []).append(re.escape(w[1:]))
    return "|".join(f"{re.escape(k)}(?:{'|'.join(rest)})" for k, rest in first.items())


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    The windows are sorted together with their places, so equal ones are neighbours: n log n for any text. Texts
    whose windows are all different, by a cheap count of distinct ones, skip the sort.
    """
    n = F.size(words)
    window = lambda i: F.concat_ws("\n", *[F.get(words, i + k) for k in range(_WINDOW)])  # noqa: E731  words hold no line feed
    places = F.when(n >= _WINDOW, F.sequence(F.lit(0), n - _WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    some = F.size(F.array_distinct(hashed)) < F.size(places)  # equal windows have equal hashes, so none is missed

    def starts(pairs: Column) -> Column:
        text = lambda k: F.get(pairs, k)["w"]
        same = F.transform(pairs, lambda p, k: F.struct(p["i"].alias("i"), (F.coalesce(p["w"] == text(k - 1), F.lit(False)) | F.coalesce(p["w"] == text(k + 1), F.lit(False))).alias("s")))
        return F.transform(F.filter(same, lambda p: p["s"]), lambda p: p["i"])

    pairs = F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[i + k for k in range(_WINDOW)])))))
    # transform over a one-element array binds the sorted pairs once instead of copying their expression
    found = F.get(F.transform(F.array(pairs), lambda p: covered(starts(p))), F.lit(0))
    return F.when(some, found).otherwise(0)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: tuple[str, ...] = STOP_WORDS, text_col: str = "text", out: str = "quality") -> DataFrame:
    """docs with the struct column `out`: measures, base_failed, kept and the names of the rules that failed.

    A row-wise projection of built-in functions: no shuffle, any text length, n log n in the words of a text. A null
    or empty text has no words, so it fails the base rules and isn't kept. Repeated rows are judged alike; an input
    column of that name, in any case, is replaced, all others stay, whatever their names; an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    carry = [quoted(c) for c in docs.columns if c.lower() != out.lower()]
    # exploding an array of one element keeps a struct from being copied into every expression that reads it; the outer
    # form gets no inferred filter, which would compute the struct again
    once = lambda df, *cols: df.select(*carry, F.explode_outer(F.array(F.struct(*cols))).alias(out))
    one = once(docs, text.alias("t"), _words(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("l"))
    t, words, real = (quoted(out)[x] for x in "twl")
    two = once(
        one,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size(real).cast("long").alias("n_lines"),
        F.size(F.array_distinct(real)).cast("long").alias("n_distinct"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
        _whole_words(F.lower(t), f"(?:{_any_of(stop_words)})[.,;:!?]*+").alias("n_stop"),
        (F.size(words) - _whole_words(t, f"[^{SPACE}\\p{{L}}]++")).alias("n_alpha"),
        F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")).alias("n_upper"),
        F.size(F.filter(real, lambda x: x.rlike(f"^[{SPACE}]*[-*•]"))).alias("n_bullet"),
        F.size(F.filter(real, lambda x: x.rlike(f"(\\.\\.\\.|…)[{SPACE}]*$"))).alias("n_ellipsis"),
    )
    q = lambda name: quoted(out)[name]
    ratio = lambda a, b: F.try_divide(q(a).cast("double"), q(b).cast("double"))
    measures = {
        "mean_word": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_ratio": ratio("n_stop", "n_words"),
        "alpha_ratio": ratio("n_alpha", "n_words"),
        "upper_ratio": ratio("n_upper", "word_chars"),
        "dup_line_ratio": F.try_divide((q("n_lines") - q("n_distinct")).cast("double"), q("n_lines").cast("double")),
        "bullet_ratio": ratio("n_bullet", "n_lines"),
        "ellipsis_ratio": ratio("n_ellipsis", "n_lines"),
    }
    failed = F.array_compact(F.array(*[F.when((q("n_words") >= r.at_least) & ~F.coalesce(measures[r.measure].between(r.low, r.high), F.lit(True)), F.lit(r.name)) for r in rules]))
    base_failed = (q("n_words") < 50) | (100 * q("n_repeat_words") > 50 * q("n_words"))
    return two.withColumn(
        out,
        F.struct(
            *[q(n) for n in ("n_words", "word_chars", "n_symbols")],
            (q("n_lines") - q("n_distinct")).alias("n_dup_lines"),
            q("n_repeat_words"),
            base_failed.alias("base_failed"),
            failed.alias("failed"),
            (~base_failed & (F.size(failed) == 0)).alias("kept"),
        ),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", deal=True).select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *[f"quality.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    check = {
        "mean_word": "word_chars::double / n_words", "symbol_ratio": "n_symbols::double / n_words", "stop_ratio": "n_stop::double / n_words", "alpha_ratio": "n_alpha::double / n_words",
        "upper_ratio": "n_upper::double / nullif(word_chars, 0)", "dup_line_ratio": "n_dup_lines::double / nullif(n_lines, 0)", "bullet_ratio": "n_bullet::double / nullif(n_lines, 0)", "ellipsis_ratio": "n_ellipsis::double / nullif(n_lines, 0)",
    }
    bound = lambda x: f"'{x}'::double"
    method = " AND ".join(f"coalesce({check[r.measure]} BETWEEN {bound(r.low)} AND {bound(r.high)}, true)" for r in RULES)
    s = SPACE
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '[{s}]+'), lambda y: y <> '') AS w, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^{s}]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::bigint AS n_words, length(regexp_replace(x, '[{s}]+', '', 'g'))::bigint AS word_chars,
  (length(x) - length(translate(x, '#*$%&|<>', '')))::bigint AS n_symbols, len(l)::bigint AS n_lines, (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(r.n, 0)::bigint AS n_repeat_words,
  len(list_filter(w, lambda y: lower(rtrim(y, '.,;:!?')) IN ({stop}))) AS n_stop, len(list_filter(w, lambda y: regexp_matches(y, '\\p{{L}}'))) AS n_alpha, length(regexp_replace(x, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
  len(list_filter(l, lambda y: regexp_matches(y, '^[{s}]*[-*•]'))) AS n_bullet, len(list_filter(l, lambda y: regexp_matches(y, '(\\.\\.\\.|…)[{s}]*$'))) AS n_ellipsis
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE {method} END AS kept FROM b"""


ORACLE = _oracle()
