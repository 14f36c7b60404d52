"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

A rule names a ratio of two measures and the range it must lie in; ``compile_rules`` turns the
table into one boolean column that compares cross products of integers, so no division rounds.
Measures are computed from the whole text by built-in array and string functions:

* words are split on ASCII white space, lines on \\n; a blank line has no word;
* repeated words are those in a window of three words that occurs twice or more in the text. The
  windows' hashes, with their place in the low bits, are sorted as plain longs; the few windows
  whose hash has an equal neighbour are then compared as text, so that the count is exact.

Defined results: a null or empty text has all measures 0 and fails the minimum length; very long
texts cost n log n; repeated rows are judged each; an empty table gives an empty result; other
columns pass through, but for those with the name of a result or of flat, words and lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import without

#: Frequent function words of the corpus's languages.
STOP_WORDS = (
    "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their"
    " der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über"
    " le la les de des du et un une est que qui dans en pour pas sur au avec ce il sont par plus ou ne se"
    " el los las y del se por con para una su al lo como más pero sus o este sí porque esta entre"
).split()
SYMBOLS = "#*$%&|<>"
_SPACE = r"[\\x09-\\x0D\\x20]+"


@dataclass(frozen=True)
class Rule:
    """low <= 100 * numerator / denominator <= high, where a bound of None is open."""

    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


#: The table in use: hundredths of a ratio.
RULES = (
    Rule("n_words", "one", low=5_000),
    Rule("word_chars", "n_words", low=200, high=1_400),
    Rule("n_symbols", "n_words", high=10),
    Rule("n_stop_words", "n_words", low=2),
    Rule("n_dup_lines", "n_lines", high=60),
    Rule("n_repeat_words", "n_words", high=50),
)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column over the measures."""
    verdict = F.lit(True)
    for rule in rules:
        over, under = F.col(rule.numerator).cast("long") * 100, F.lit(1).cast("long") if rule.denominator == "one" else F.col(rule.denominator).cast("long")
        if rule.low is not None:
            verdict = verdict & (over >= under * rule.low)
        if rule.high is not None:
            verdict = verdict & (over <= under * rule.high)
    return verdict


def _let(value: str, name: str, body: str) -> str:
    """Evaluates value once and binds it in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """SQL for the number of words in repeated windows of three; w: the words, n: their number."""
    hashes = "transform(sequence(0, n - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | cast(i as bigint))"
    near = "(k > 0 and shiftrightunsigned(get(s, k - 1), b) = shiftrightunsigned(x, b)) or (k + 1 < size(s) and shiftrightunsigned(get(s, k + 1), b) = shiftrightunsigned(x, b))"
    suspects = "transform(" + _let(f"sort_array({hashes})", "s", f"filter(s, (x, k) -> {near})") + ", x -> cast(x & (shiftleft(1L, b) - 1) as int))"
    texts = "array_sort(transform(c, i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) as g, i as i)))"
    same = "(k > 0 and get(t, k - 1).g = x.g) or (k + 1 < size(t) and get(t, k + 1).g = x.g)"
    places = _let(texts, "t", f"sort_array(transform(filter(t, (x, k) -> {same}), x -> x.i))")
    covered = _let(places, "d", "aggregate(sequence(0, size(d)), 0L, (a, k) -> a + case when k >= size(d) then 0L when k + 1 = size(d) then 3L else cast(least(3, get(d, k + 1) - get(d, k)) as bigint) end)")
    exact = _let(suspects, "c", f"if(size(c) = 0, 0L, {covered})")
    return "if(n_words < 4, 0L, " + _let("words", "w", _let("cast(n_words as int)", "n", _let("cast(ceil(log2(n_words + 1)) as int)", "b", exact))) + ")"


def measure(docs: DataFrame, text_col: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words and n_repeat_words."""
    docs = without(docs, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words", "base_failed", "kept", "flat", "words", "lines")
    text = f"coalesce(cast(`{text_col}` as string), '')"
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words)
    flat = docs.withColumn("flat", F.expr(f"trim(BOTH ' ' FROM regexp_replace({text}, '{_SPACE}', ' '))"))
    split = flat.withColumn("words", F.expr("if(flat = '', cast(array() as array<string>), split(flat, ' '))")).withColumn("lines", F.expr(f"filter(split({text}, '\\n'), l -> l rlike '[^\\\\x09-\\\\x0D\\\\x20]')"))
    counted = split.select(
        *[f"`{c}`" for c in docs.columns],
        "words",
        F.expr("cast(size(words) as bigint)").alias("n_words"),
        F.expr("cast(length(flat) - greatest(size(words) - 1, 0) as bigint)").alias("word_chars"),
        F.expr(f"cast(length({text}) - length(regexp_replace({text}, '[{SYMBOLS}]+', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) as bigint)").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr(f"cast(size(filter(words, w -> lower(w) in ({listed}))) as bigint)").alias("n_stop_words"),
    )
    return counted.withColumn("n_repeat_words", F.expr(_repeat_words())).drop("words")


def judged(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with their measures, base_failed and kept."""
    measured = measure(docs, text_col)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
