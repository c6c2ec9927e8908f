"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auch auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "au aux dans de des du en est et la le les par pas pour que qui sur un une "
    "al como con de del el en es la las lo los no para por que se su un una y"
)


@dataclass(frozen=True)
class Rule:
    """A document passes where ``low <= metric <= high``; a bound of None is open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Ratios are of words, lines or code points, as their metrics say.
RULES = (
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.15),
    Rule("exclamation_ratio", None, 0.5),
    Rule("capital_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.04, None),
    Rule("same_word_ratio", None, 0.3),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.5),
)


def _count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: str, hashes: str, pairs: str) -> Column:
    """Words covered by windows that occur twice or more; ``pairs`` are sorted (hash, place) structs."""
    same = f"filter({pairs}, (p, k) -> p.h <=> get({pairs}, k - 1).h OR p.h <=> get({pairs}, k + 1).h)"
    spots = f"array_sort(transform({same}, p -> p.i))"
    return F.expr(f"aggregate({spots}, named_struct('n', 0L, 'end', 0), (s, x) -> named_struct('n', s.n + x + {WINDOW} - greatest(x, s.end), 'end', x + {WINDOW}), s -> s.n)")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds the base counts and the ratios that rules refer to, as columns, to ``docs``.

    Words are runs of characters other than ASCII white space; lines are split at ``\\n`` and count if they
    hold a word. Null and empty texts have no words, and ratios of nothing are 0. Rows are measured one by
    one, so repeats measure alike; columns of ``docs`` that have a measure's name are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.expr
    step = docs.withColumn("_text", text)
    step = step.withColumns({
        "_words": F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0),
    })
    step = step.withColumns({"n_words": F.size("_words").cast("long"), "n_lines": F.size("_lines").cast("long")})
    step = step.withColumn("_hashes", raw(f"CASE WHEN n_words < {WINDOW} THEN array() ELSE transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))) END").cast("array<long>"))
    step = step.withColumn("_pairs", raw("CASE WHEN size(array_distinct(_hashes)) < size(_hashes) THEN array_sort(transform(_hashes, (x, i) -> named_struct('h', x, 'i', i))) END"))
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    stop = sorted(set(STOP_WORDS.split()))
    step = step.withColumns({
        "word_chars": (F.length("_text") - _count_chars(F.col("_text"), SPACE)).cast("long"),
        "n_symbols": _count_chars(F.col("_text"), SYMBOLS),
        "n_dup_lines": (F.col("n_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(_repeat_words("_words", "_hashes", "_pairs"), F.lit(0)).cast("long"),
        "_stop": F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))),
        "_same": F.size(F.expr("filter(_words, (w, k) -> w = get(_words, k - 1))")),
        "_bullets": F.size(F.filter("_lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))),
        "_ellipses": F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    })
    step = step.withColumns({
        "mean_word_length": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "exclamation_ratio": _count_chars(F.col("_text"), "!") / words,
        "capital_ratio": _count_chars(F.col("_text"), CAPITALS) / F.greatest("word_chars", F.lit(1)),
        "stop_word_ratio": F.col("_stop") / words,
        "same_word_ratio": F.col("_same") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "bullet_line_ratio": F.col("_bullets") / lines,
        "ellipsis_line_ratio": F.col("_ellipses") / lines,
    })
    return step.drop("_text", "_words", "_lines", "_hashes", "_pairs", "_stop", "_same", "_bullets", "_ellipses")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a measured row fails, joined by commas."""
    failed = []
    for rule in rules:
        value = F.col(rule.metric)
        out = F.lit(False)
        if rule.low is not None:
            out = out | (value < rule.low)
        if rule.high is not None:
            out = out | (value > rule.high)
        failed.append(F.when(out, F.lit(rule.metric)))
    return F.concat_ws(",", *failed) if failed else F.lit("")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measure`` plus ``base_failed``, ``failed_rules`` (names, comma-joined) and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` % of them in repeated
    8-word windows. ``kept``: neither that nor any rule failed. Empty and null texts fail the base.
    """
    measured = measure(docs, id_col, text_col)
    measured = measured.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    measured = measured.withColumn("failed_rules", compile_rules(rules))
    # the last term is always true; as it isn't deterministic, a filter on the verdict stays above the measuring and isn't
    # rewritten to repeat it
    return measured.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "") & (F.monotonically_increasing_id() >= 0))
