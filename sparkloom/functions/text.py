"""Text functions for scoring model outputs, as Column expressions.

Unicode compatibility normalisation needs Python (an Arrow-batched UDF): Spark has no function for it.
Repetition and the share of printable characters are found there too: as nested array functions and
regular expressions they take several times the processor time.  Everything else stays in the JVM, so it
fuses with the scan and the aggregation around it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space as Python sees it: Java's class and the four information separators.
BLANK = r"(?U)[\s\x1c-\x1f]"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# What counts as a word, a number and the marks around thoughts and turns.
WORDS = r"[0-9a-z]+|[\u4e00-\u9fff]+"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
THOUGHTS, THOUGHTS_END, TURN_MARK = "<think>", "</think>", r"<\|[^>]*\|>"
# How an answer names its letter, in the order in which they are tried.
LETTERS = (r"^\(?([A-E])(?=(?U:[\s.):])|$)", r"(?U)(?:[Aa]nswer|[Oo]ption)\s*(?:is|:)?\s*\(?\b([A-E])\b", r"(?U)\b([A-E])\b")

# The words that decide a check of agreement.
NEGATIVES = ("不", "别", "无", "no", "not", "false", "否", "错", "wrong", "non")
AFFIRMATIVES = ("是", "对", "是的", "yes", "true", "correct", "right", "的确")
# The three colours a check asks for, and the colour words that must be absent.
COLOURS_WANTED = (("red", "红"), ("green", "绿"), ("blue", "蓝"))
COLOURS_OTHER = ("yellow", "黄", "purple", "紫", "orange", "橙", "pink", "粉", "brown", "棕", "black", "黑", "white", "白", "gray", "grey", "灰", "gold", "金", "silver", "银", "violet", "cyan", "beige", "teal")
# The anomalies that make an answer count as wrong.
BLOCKING = ("truncated", "repetition_loop", "empty_output", "garbled", "replacement_chars", "control_chars")

LEAST_PRINTABLE = 0.85
CHECK = "struct<type:string,patterns:array<string>,value:double,target:string,max_chars:int,affirmative:boolean>"


def strip(text: Column) -> Column:
    """The text without white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def squeezed(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{BLANK}+", " "))


def lines(text: Column) -> Column:
    """The lines with something in them, stripped."""
    return F.filter(F.transform(F.split(strip(text), LINE_END), strip), lambda x: x != "")


def after_thinking(raw: Column) -> Column:
    """What follows the first mark that ends a section of thoughts; all of it without such a mark."""
    at = F.instr(raw, THOUGHTS_END)
    return F.when(at > 0, F.substring(raw, at + len(THOUGHTS_END), F.length(raw))).otherwise(raw)


def extract_final(raw: Column) -> Column:
    rest = after_thinking(raw)
    return strip(F.when(F.contains(rest, F.lit("<|")), F.regexp_replace(rest, TURN_MARK, "")).otherwise(rest))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in xs])


def bare(text: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def norm(text: Column) -> Column:
    return bare(nfkc(text))


def norm_patterns(patterns: Column) -> Column:
    return F.transform(nfkc_all(patterns), bare)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def _printable(text: str) -> float:
    body = "".join(text.split())
    if body.isprintable() and "\ufffd" not in body:
        return 1.0
    return sum(n for c, n in Counter(body).items() if c.isprintable() and c != "\ufffd") / len(body)


@F.pandas_udf(T.DoubleType())
def printable_ratio(text: pd.Series) -> pd.Series:
    """Share of the non-space characters that can be printed; 1 without any."""
    return pd.Series([None if x is None else _printable(x) for x in text], dtype="Float64")


def printable_share_of_all(text: Column) -> Column:
    """As for generated files: line ends and tabs count as printable, spaces count, and nothing is 0."""
    good = F.length(F.regexp_replace(text, r"(?U)(?![\n\t ])[\p{C}\p{Z}]", ""))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(good / F.greatest(F.length(text), F.lit(1)))


def _tail_repeats(s: str, most: int) -> bool:
    """Whether the text ends with a block of 8 to ``most`` characters twice."""
    end = s[-2 * most :]
    n = len(end)
    return any(end[n - k :] == end[n - 2 * k : n - k] for k in range(8, min(most, n // 2) + 1))


#: Texts with a run longer than this look for each of their runs at once.
LONG_RUN = 200
#: So do texts with so little to search: characters of all runs, times different runs.
SHORT_SEARCH = 20_000


def _segment_repeats(s: str) -> bool:
    """A run of ten characters or more without a space that the text holds five times.

    A run can only stand inside another run, and as often as it fits there.  Its first ten characters then
    occur five times among all stretches of ten, which are counted; only runs that begin so are searched for.
    """
    runs = [x for x in s.split(" ") if len(x) >= 10]
    if sum(len(x) // 10 for x in runs) < 5:
        return False
    hay, likely = " ".join(runs), set(runs)
    if len(likely) * len(hay) > SHORT_SEARCH and max(map(len, likely)) <= LONG_RUN:
        stretches = Counter(x[i : i + 10] for x in runs for i in range(len(x) - 9))
        likely = {x for x in likely if stretches[x[:10]] >= 5}
    return any(hay.count(x) >= 5 for x in likely)


ONE_CHARACTER = re.compile(r"(.)\1{29}", re.DOTALL)


def _one_character(s: str) -> bool:
    """Thirty times the same character: they fill one of the blocks of 15 that the text is cut into."""
    return any(s[p] == s[p + 14] and s[p : p + 15] == s[p] * 15 for p in range(0, len(s) - 14, 15)) and ONE_CHARACTER.search(s) is not None


def _four_lines(text: str) -> bool:
    """Whether the last four lines with something in them are the same."""
    last = [y for x in text.strip().splitlines() if (y := x.strip())][-4:]
    return len(last) == 4 and last.count(last[0]) == 4


def _repetition(text: str | None) -> tuple[bool | None, bool | None]:
    if text is None:
        return None, None
    s = " ".join(text.split())
    if len(s) < 48:
        return False, False
    segment = _segment_repeats(s)
    loops = len(s) >= 64 and (segment or _tail_repeats(s, 64) or _four_lines(text) or _one_character(s))
    return loops, segment or _tail_repeats(s, 48)


@F.pandas_udf(T.StructType([T.StructField("loops", T.BooleanType()), T.StructField("repeats", T.BooleanType())]))
def repetition_flags(text: pd.Series) -> pd.DataFrame:
    """A struct (loops, repeats): ``is_repetition_loop`` and ``is_repetition`` of one text, whose common parts are computed once."""
    return pd.DataFrame([_repetition(x) for x in text], columns=["loops", "repeats"], dtype=object)


def is_repetition_loop(text: Column) -> Column:
    """Whether an output ran into a loop: its tail, a segment, its last lines or one character."""
    return repetition_flags(text)["loops"]


def is_repetition(text: Column) -> Column:
    """The same for answers to multiple-choice questions, by tail and segment alone."""
    return repetition_flags(text)["repeats"]


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def extract_letter(raw: Column) -> Column:
    """The option letter of a completion, null if there is none or the thoughts never end."""
    s = strip(after_thinking(raw))
    endless = (F.instr(raw, THOUGHTS_END) == 0) & (F.instr(raw, THOUGHTS) > 0)
    letter = F.coalesce(*[_found(s, p) for p in LETTERS])
    return F.when(endless, F.lit(None).cast("string")).otherwise(letter)


def count_of(text: Column, characters: str) -> Column:
    """How many characters of the class there are."""
    return F.length(text) - F.length(F.regexp_replace(text, characters, ""))


def _flags(*pairs: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))


def detect_anomalies(raw: Column, final: Column, truncated: Column) -> Column:
    """The anomalies of one output, in a fixed order; null counts as empty and not truncated."""
    raw, final = F.coalesce(raw, F.lit("")), F.coalesce(final, F.lit(""))
    return _flags(
        ("empty_output", (strip(raw) == "") | (strip(final) == "")),
        ("garbled", printable_ratio(final) < LEAST_PRINTABLE),
        ("repetition_loop", is_repetition_loop(final)),
        ("replacement_chars", F.length(raw) - F.length(F.replace(raw, F.lit("\ufffd"), F.lit(""))) >= 3),
        ("control_chars", count_of(raw, r"[\x00-\x08\x0b\x0c\x0e-\x1f]") >= 3),
        ("truncated", F.coalesce(truncated, F.lit(False))),
    )


def choice_anomalies(raw: Column, letter: Column, repetition: Column, truncated: Column) -> Column:
    """For multiple choice: a loop counts if the output was cut off, a cut if there is no letter."""
    cut = F.coalesce(truncated, F.lit(False))
    return _flags(("empty_output", strip(F.coalesce(raw, F.lit(""))) == ""), ("no_letter", letter.isNull()), ("repetition_loop", F.coalesce(repetition, F.lit(False)) & cut), ("truncated", cut & letter.isNull()))


def _any_in(patterns: Column, text: Column) -> Column:
    return F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.contains(text, p))


def _constants(values, text: Column) -> Column:
    return _any_in(F.array(*[F.lit(v) for v in values]), text)


def check_passes(check: Column, final: Column, normal: Column) -> Column:
    """One check against a final answer. ``normal`` is ``norm(final)``; patterns are normalised already, as ``norm_patterns`` does."""
    kind, patterns = check["type"], F.coalesce(check["patterns"], F.array().cast("array<string>"))
    numbers = F.regexp_extract_all(final, F.lit(NUMBER), F.lit(0))
    joined, said = F.concat_ws("", words(final)), F.coalesce(check["affirmative"], F.lit(True))
    single = F.size(F.filter(F.split(strip(final), f"{BLANK}+"), lambda w: w != "")) == 1
    colours = ~_constants(COLOURS_OTHER, normal)
    for group in COLOURS_WANTED:
        colours = colours & _constants(group, normal)
    passed = (
        F.when(kind == "open", F.lit(True))
        .when(kind == "contains", _any_in(patterns, normal))
        .when(kind == "number", (F.size(numbers) == 1) & (F.abs(F.get(numbers, F.lit(0)).try_cast("double") - check["value"]) < 1e-9))
        .when(kind == "affirm", F.when(_constants(NEGATIVES, joined), ~said).otherwise(said & _constants(AFFIRMATIVES, joined)))
        .when(kind == "token", F.arrays_overlap(words(final), patterns))
        .when(kind == "one_word", single & F.array_contains(patterns, normal))
        .when(kind == "yes_no", normal.isin("yes", "no") & (normal == check["target"]))
        .when(kind == "all_colors", colours)
        .when(kind == "max_chars", (F.length(normal) <= check["max_chars"]) & _any_in(patterns, normal))
        .otherwise(F.raise_error(F.concat(F.lit("unknown check type: "), kind)).cast("boolean"))
    )
    return F.coalesce(passed, F.lit(False))


def is_correct(checks: Column, final: Column, normal: Column) -> Column:
    """Whether any check passes."""
    return F.exists(checks, lambda c: check_passes(c, final, normal))


def gated_correct(checks: Column, final: Column, normal: Column, anomalies: Column) -> Column:
    """Correct, and free of anomalies that block."""
    return ~F.arrays_overlap(anomalies, F.array(*[F.lit(b) for b in BLOCKING])) & is_correct(checks, final, normal)


def perf(log: Column) -> Column:
    """Timings that a runner prints: milliseconds as doubles and the number of evaluated tokens."""
    took = lambda what: F.regexp_extract(log, rf"(?:^|[^\w ]|\n) *(?:\S+: +)?{what} time\s*=\s*([0-9.]+)\s*ms", 1).try_cast("double")
    evals = r"eval time\s*=\s*[0-9.]+\s*ms\s*/\s*([0-9]+) runs"
    eval_ms = F.regexp_extract(log, r"eval time\s*=\s*([0-9.]+)\s*ms\s*/\s*[0-9]+ runs", 1).try_cast("double")
    return F.struct(took("load").alias("load_ms"), took("prompt eval").alias("prompt_ms"), eval_ms.alias("eval_ms"), F.regexp_extract(log, evals, 1).try_cast("int").alias("eval_tokens"))


def clean_stdout(text: Column) -> Column:
    """A runner's output without the echoed turns and the line that marks its end."""
    at = F.instr(text, "\nassistant\n")
    return strip(F.regexp_replace(F.when(at > 0, F.substring(text, at + 11, F.length(text))).otherwise(text), r"(?m)^>?\s*EOF by user\s*$", ""))


def rtrim_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)[ \t]+$", "")


# Fixed value: the wording of a multiple-choice prompt.
PROMPT = "The following is a multiple choice question. Answer with only the letter of the correct option.\n\nQuestion: {question}\n{choices}\nAnswer:"


def render_prompt(question: Column, labels: Column, texts: Column) -> Column:
    before, _, rest = PROMPT.partition("{question}")
    between, _, after = rest.partition("{choices}")
    choices = F.array_join(F.zip_with(labels, texts, lambda a, b: F.concat(a, F.lit(". "), b)), "\n")
    return F.concat(F.lit(before), strip(question), F.lit(between), choices, F.lit(after))


def short_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def answer_key(key: Column) -> Column:
    """1 to 5 as A to E, other keys in upper case; null if that isn't a letter of the five."""
    up = F.upper(strip(key.cast("string")))
    got = F.when(up.rlike("^[1-5]$"), F.translate(up, "12345", "ABCDE")).otherwise(up)
    return F.when(got.rlike("^[A-E]$"), got)


def choice_labels(labels: Column) -> Column:
    """Letters of labels such as ``(B)`` or ``B.``; the position's letter for others."""
    position = F.array(*[F.lit(c) for c in "ABCDE"])
    return F.transform(labels, lambda x, i: F.coalesce(_found(F.upper(strip(x)), r"^\(?([A-E])[).:]?$"), F.get(position, i)))
