"""Evaluation queries: text functions, checks, pairing, rates and gates over the driver tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import records
from ..sources.records import normal_checks
from . import calibration, reports, scoring
from .catalogue import query

SPACE_SQL = "[\\s\\x0b\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE_SQL}+', ''), '{SPACE_SQL}+$', '')"


def squeeze_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '{SPACE_SQL}+', ' ', 'g')")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_sql(x: str) -> str:
    """The same for texts without compatibility characters, of which the driver's tables have none."""
    return f"lower(regexp_replace(nfc_normalize({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


@query("q_text_norm", f"SELECT doc_id, {norm_sql('text')} AS normal FROM documents")
def text_norm(spark, sf_dir):
    """SQL folds no compatibility characters; tests compare with a plain Python version on texts that have some."""
    return table(spark, sf_dir, "documents").select("doc_id", text.norm(F.coalesce("text", F.lit(""))).alias("normal"))


@query("q_text_words", "SELECT doc_id, len(w)::INTEGER AS n, len(list_distinct(w))::INTEGER AS distinct_n, w[1] AS first FROM (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z]+|[\\x{4e00}-\\x{9fff}]+') AS w FROM documents)")
def text_words(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("distinct_n"), F.get("w", F.lit(0)).alias("first"))


def _loop_sql(s: str, most: int) -> str:
    return f"""len(list_filter(range(8, {most + 1}), lambda k: length({s}) >= 2 * k AND right({s}, k) = substring({s}, length({s}) - 2 * k + 1, k))) > 0
 OR len(list_filter(list_distinct(regexp_extract_all({s}, '\\S{{10,}}')), lambda g: (length({s}) - length(replace({s}, g, ''))) // length(g) >= 5)) > 0"""


LOOP_SQL = f"""WITH d AS (SELECT doc_id, text AS t, {squeeze_sql("text")} AS s FROM documents), l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x0b\\x0c]'), lambda x: {strip_sql("x")}), lambda x: x <> '') AS ln FROM d)
SELECT doc_id, length(s) >= 64 AND ({_loop_sql("s", 64)} OR (len(ln) >= 4 AND len(list_distinct(ln[-4:])) = 1) OR len(list_filter(list_distinct(string_split(s, '')), lambda c: contains(s, repeat(c, 30)))) > 0) AS loops, length(s) >= 48 AND ({_loop_sql("s", 48)}) AS repeats FROM l"""


@query("q_text_repetition_loop", LOOP_SQL)
def repetition(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.repetition_flags(F.col("text")).alias("f")).select("doc_id", "f.loops", "f.repeats")


def printable_sql(x: str) -> str:
    body = f"length(regexp_replace({x}, '{SPACE_SQL}', '', 'g'))"
    return f"CASE WHEN {body} = 0 THEN 1.0 ELSE length(regexp_replace({x}, '[\\p{{C}}\\p{{Z}}\\s\\x{{fffd}}]', '', 'g')) / {body}::DOUBLE END"


#: Characters that don't count as printable in a whole text, as far as the tables or the query have any.
UNPRINTABLE_SQL = "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{a0}]"
ODD_SQL = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN text || repeat(chr(1) || chr(160), (doc_id % 50)::INTEGER) WHEN 2 THEN '�' || text ELSE replace(replace(text, chr(10), ' '), ' ', '_') END"


@query("q_text_printable", f"SELECT doc_id, round({printable_sql('t')}, 9) AS ratio, round(CASE WHEN length(t) = 0 THEN 0 ELSE length(regexp_replace(t, '{UNPRINTABLE_SQL}', '', 'g')) / length(t)::DOUBLE END, 9) AS share FROM (SELECT doc_id, {ODD_SQL} AS t FROM documents)")
def printable(spark, sf_dir):
    """Both ratios, with characters that can't be printed put into a part of the texts."""
    k, t = F.col("doc_id") % 4, F.col("text")
    odd = F.repeat(F.lit("\x01\xa0"), (F.col("doc_id") % 50).cast("int"))
    mixed = F.when(k == 0, "").when(k == 1, F.concat(t, odd)).when(k == 2, F.concat(F.lit("\ufffd"), t)).otherwise(F.regexp_replace(F.regexp_replace(t, "\n", " "), " ", "_"))
    d = table(spark, sf_dir, "documents").select("doc_id", mixed.alias("t"))
    return d.select("doc_id", F.round(text.printable_ratio(F.col("t")), 9).alias("ratio"), F.round(text.printable_share_of_all(F.col("t")), 9).alias("share"))


SAID_SQL = "CASE WHEN turn % 4 = 0 THEN '<think>so' || chr(10) || '</think> <|im_start|>' || text || '<|im_end|> ' WHEN turn % 4 = 1 THEN '<think>' || text ELSE '  ' || text || chr(10) END"


def said() -> Column:
    """Turns as raw outputs: with thoughts and marks, with thoughts that never end, and plain."""
    k, t = F.col("turn") % 4, F.col("text")
    return F.when(k == 0, F.concat(F.lit("<think>so\n</think> <|im_start|>"), t, F.lit("<|im_end|> "))).when(k == 1, F.concat(F.lit("<think>"), t)).otherwise(F.concat(F.lit("  "), t, F.lit("\n")))


def final_sql(x: str) -> str:
    return strip_sql(f"regexp_replace(CASE WHEN contains({x}, '</think>') THEN substr({x}, instr({x}, '</think>') + 8) ELSE {x} END, '<\\|[^>]*\\|>', '', 'g')")


@query("q_extract_final", f"SELECT conv_id, turn, {final_sql('raw')} AS final FROM (SELECT conv_id, turn, {SAID_SQL} AS raw FROM conversations)")
def final(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.extract_final(said()).alias("final"))


@query("q_extract_letter", f"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN '(' || upper(substr(text, 1, 1)) || ') ' || text WHEN turn % 5 = 1 THEN '<think>so</think> The answer is C. ' || text WHEN turn % 5 = 2 THEN '<think>' || text ELSE text END AS t FROM conversations),
s AS (SELECT *, {strip_sql("CASE WHEN contains(t, '</think>') THEN substr(t, instr(t, '</think>') + 8) ELSE t END")} AS a FROM c)
SELECT conv_id, turn, CASE WHEN contains(t, '<think>') AND NOT contains(t, '</think>') THEN NULL ELSE coalesce(nullif(regexp_extract(a, '^\\(?([A-E])(?:[\\s.):]|$)', 1), ''), nullif(regexp_extract(a, '(?:[Aa]nswer|[Oo]ption)\\s*(?:is|:)?\\s*\\(?\\b([A-E])\\b', 1), ''), nullif(regexp_extract(regexp_replace(a, '[^\\x00-\\x7f]', 'x', 'g'), '\\b([A-E])\\b', 1), '')) END AS letter FROM s""")
def letters(spark, sf_dir):
    t, k = F.col("text"), F.col("turn") % 5
    asked = F.when(k == 0, F.concat(F.lit("("), F.upper(F.substring(t, 1, 1)), F.lit(") "), t)).when(k == 1, F.concat(F.lit("<think>so</think> The answer is C. "), t)).when(k == 2, F.concat(F.lit("<think>"), t)).otherwise(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.extract_letter(asked).alias("letter"))


@query("q_extract_number_check", "WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'It is ' || (props->>'k') || '.' WHEN event_id % 3 = 1 THEN (props->>'k') || ', then ' || user_id ELSE event_type END AS t, event_id % 100 AS v FROM events), n AS (SELECT *, regexp_extract_all(t, '-?[0-9]+(?:\\.[0-9]+)?') AS x FROM e) SELECT event_id, len(x)::INTEGER AS numbers, len(x) = 1 AND x[1]::DOUBLE = v AS passed FROM n")
def number_check(spark, sf_dir):
    k, m = F.get_json_object("props", "$.k"), F.col("event_id") % 3
    said = F.when(m == 0, F.concat(F.lit("It is "), k, F.lit("."))).when(m == 1, F.concat(k, F.lit(", then "), F.col("user_id").cast("string"))).otherwise(F.col("event_type"))
    check = F.struct(F.lit("number").alias("type"), F.lit(None).cast("array<string>").alias("patterns"), (F.col("event_id") % 100).cast("double").alias("value"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("max_chars"), F.lit(None).cast("boolean").alias("affirmative"))
    e = table(spark, sf_dir, "events").select("event_id", said.alias("said"), check.alias("check"))
    return e.select("event_id", F.size(F.regexp_extract_all("said", F.lit(text.NUMBER), F.lit(0))).alias("numbers"), text.check_passes(F.col("check"), F.col("said"), F.lower("said")).alias("passed"))


@query("q_check_kinds", """WITH c AS (SELECT conv_id, turn, lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS n, array_to_string(regexp_extract_all(lower(text), '[0-9a-z]+|[\\x{4e00}-\\x{9fff}]+'), '') AS j, regexp_extract_all(lower(text), '[0-9a-z]+|[\\x{4e00}-\\x{9fff}]+') AS w FROM conversations)
SELECT conv_id, turn, contains(n, 'the') AS contains_it, NOT (contains(j, 'no') OR contains(j, 'not') OR contains(j, 'false') OR contains(j, 'wrong') OR contains(j, 'non')) AND (contains(j, 'yes') OR contains(j, 'true') OR contains(j, 'correct') OR contains(j, 'right')) AS affirms, list_contains(w, 'the') AS token, length(n) <= 100 AND contains(n, 'e') AS short FROM c""")
def check_kinds(spark, sf_dir):
    """Checks whose patterns are plain letters, so that compatibility folding changes nothing."""
    kind = lambda name, patterns, most=None: F.struct(F.lit(name).alias("type"), F.array(*[F.lit(p) for p in patterns]).cast("array<string>").alias("patterns"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("target"), F.lit(most).cast("int").alias("max_chars"), F.lit(True).alias("affirmative"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", text.bare(F.col("text")).alias("n"))
    passes = lambda *a: text.check_passes(kind(*a), F.col("text"), F.col("n"))
    return c.select("conv_id", "turn", passes("contains", ["the"]).alias("contains_it"), passes("affirm", []).alias("affirms"), passes("token", ["the"]).alias("token"), passes("max_chars", ["e"], 100).alias("short"))


MORE_SQL = f"""a AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'Yes!' WHEN 1 THEN ' no. ' WHEN 2 THEN 'red, Green and blue' WHEN 3 THEN 'red green blue, gold too' WHEN 4 THEN regexp_extract(text, '\\S+') ELSE text END AS f FROM conversations),
n AS (SELECT *, {norm_sql("f")} AS n FROM a),
k AS (SELECT *, true AS open, {strip_sql("f")} <> '' AND NOT regexp_matches({strip_sql("f")}, '\\s') AND n IN ('the', 'la', 'yes') AS one_word, n = 'no' AS yes_no, contains(n, 'red') AND contains(n, 'green') AND contains(n, 'blue') AND NOT contains(n, 'gold') AND length(regexp_replace(n, 'yellow|purple|orange|pink|brown|black|white|gray|grey|silver|violet|cyan|beige|teal', '', 'g')) = length(n) AS all_colors FROM n)
"""


def more_answers(spark, sf_dir) -> DataFrame:
    k = F.col("turn") % 6
    f = F.when(k == 0, "Yes!").when(k == 1, " no. ").when(k == 2, "red, Green and blue").when(k == 3, "red green blue, gold too").when(k == 4, F.regexp_extract("text", r"\S+", 0)).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", f.alias("f")).withColumn("n", text.norm(F.col("f")))


def one_check(kind: str, patterns=(), target=None) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.array(*[F.lit(p) for p in patterns]).cast("array<string>").alias("patterns"), F.lit(None).cast("double").alias("value"), F.lit(target).cast("string").alias("target"), F.lit(None).cast("int").alias("max_chars"), F.lit(True).alias("affirmative"))


CHECKS = {"open": ("open", (), None), "one_word": ("one_word", ("the", "la", "yes"), None), "yes_no": ("yes_no", (), "no"), "all_colors": ("all_colors", (), None)}


@query("q_check_kinds_more", f"WITH {MORE_SQL} SELECT conv_id, turn, open, one_word, yes_no, all_colors FROM k")
def check_kinds_more(spark, sf_dir):
    return more_answers(spark, sf_dir).select("conv_id", "turn", *[text.check_passes(one_check(*c), F.col("f"), F.col("n")).alias(name) for name, c in CHECKS.items()])


@query("q_check_any_and_gated", f"WITH {MORE_SQL} SELECT conv_id, turn, one_word OR yes_no OR all_colors AS correct, (one_word OR yes_no OR all_colors) AND turn % 7 <> 0 AND turn % 5 <> 0 AS gated FROM k")
def any_check(spark, sf_dir):
    """A question passes if any check does, and counts if no blocking anomaly is there; ``no_letter`` doesn't block."""
    checks = F.array(*[one_check(*CHECKS[c]) for c in ("one_word", "yes_no", "all_colors")])
    flags = F.array_compact(F.array(F.when(F.col("turn") % 7 == 0, "garbled"), F.when(F.col("turn") % 5 == 0, "truncated"), F.lit("no_letter")))
    a = more_answers(spark, sf_dir)
    return a.select("conv_id", "turn", text.is_correct(checks, F.col("f"), F.col("n")).alias("correct"), text.gated_correct(checks, F.col("f"), F.col("n"), flags).alias("gated"))


@query("q_runner_log", "SELECT event_id, round(value, 2) AS load_ms, round(value + 1, 2) AS prompt_ms, round(value * 2, 2) AS eval_ms, user_id::INTEGER AS eval_tokens, event_type AS answer, event_type || chr(10) || '  x' AS trimmed FROM events")
def runner_log(spark, sf_dir):
    """Timings, echoed turns and the mark of the end, as a runner prints them."""
    v = lambda c: F.format_string("%.2f", F.round(c, 2))
    log = F.concat(F.lit("lm: load time = "), v(F.col("value")), F.lit(" ms\nlm: prompt eval time = "), v(F.col("value") + 1), F.lit(" ms / 9 tokens\nlm:        eval time = "), v(F.col("value") * 2), F.lit(" ms / "), F.col("user_id").cast("string"), F.lit(" runs\n"))
    out = F.concat(F.lit("user\nhi\nassistant\n"), F.col("event_type"), F.lit("\n> EOF by user\n"))
    e = table(spark, sf_dir, "events").select("event_id", text.perf(log).alias("p"), text.clean_stdout(out).alias("answer"), text.rtrim_lines(F.concat(F.col("event_type"), F.lit(" \t\n  x  "))).alias("trimmed"))
    return e.select("event_id", "p.load_ms", "p.prompt_ms", "p.eval_ms", "p.eval_tokens", "answer", "trimmed")


ANOMALY_SQL = f"""a AS (SELECT doc_id, lang, list_filter([CASE WHEN {strip_sql("text")} = '' THEN 'empty_output' END, CASE WHEN length(text) - length(replace(text, '�', '')) >= 3 THEN 'replacement_chars' END, CASE WHEN len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) >= 3 THEN 'control_chars' END, CASE WHEN length(text) > 4000 THEN 'truncated' END], lambda x: x IS NOT NULL) AS f FROM documents)"""


def flagged(spark, sf_dir) -> DataFrame:
    """Anomalies that have the same meaning in both engines; the loop has a query of its own."""
    t = F.col("text")
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in (("empty_output", text.strip(t) == ""), ("replacement_chars", text.count_of(t, "�") >= 3), ("control_chars", text.count_of(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]") >= 3), ("truncated", F.length(t) > 4000))]))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", flags.alias("flags"))


@query("q_anomaly_flags", f"WITH {ANOMALY_SQL} SELECT doc_id, array_to_string(f, ',') AS flags FROM a")
def anomaly_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("doc_id", F.array_join("flags", ",").alias("flags"))


@query("q_anomaly_breakdown", f"WITH {ANOMALY_SQL} SELECT lang, anomaly, count(*) AS n FROM (SELECT lang, unnest(f) AS anomaly FROM a) GROUP BY ALL")
def breakdown(spark, sf_dir):
    return scoring.anomaly_breakdown(flagged(spark, sf_dir), "flags", ["lang"])


def loop_sql(source: str, key: str, column: str) -> str:
    """(key, loops): ``LOOP_SQL`` over another source."""
    return LOOP_SQL.replace("doc_id", key).replace("FROM documents", f"FROM {source}").replace("text AS t", f"{column} AS t").replace(squeeze_sql("text"), squeeze_sql(column))


def anomalies_sql(raw: str, final: str, cut: str, loops: str) -> str:
    return f"""list_filter([CASE WHEN {strip_sql(raw)} = '' OR {final} = '' THEN 'empty_output' END, CASE WHEN {final} <> '' AND {printable_sql(final)} < 0.85 THEN 'garbled' END, CASE WHEN {final} <> '' AND {loops} THEN 'repetition_loop' END,
 CASE WHEN length({raw}) - length(replace({raw}, '�', '')) >= 3 THEN 'replacement_chars' END, CASE WHEN len(regexp_extract_all({raw}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) >= 3 THEN 'control_chars' END, CASE WHEN {cut} THEN 'truncated' END], lambda x: x IS NOT NULL)"""


@query("q_detect_anomalies", f"WITH f AS (SELECT doc_id, text AS raw, {final_sql('text')} AS final FROM documents), z AS ({loop_sql('f', 'doc_id', 'final')}) SELECT doc_id, array_to_string({anomalies_sql('raw', 'final', 'length(raw) > 4000', 'loops')}, ',') AS anomalies FROM f JOIN z USING (doc_id)")
def detect(spark, sf_dir):
    """All anomalies of every document as an output; tests hold a Python version against it for characters that the tables lack."""
    raw = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.detect_anomalies(raw, text.extract_final(raw), F.length(raw) > 4000), ",").alias("anomalies"))


@query("q_prompt_hash_render", f"WITH p AS (SELECT item_id, 'The following is a multiple choice question. Answer with only the letter of the correct option.' || chr(10) || chr(10) || 'Question: ' || {strip_sql('text')} || chr(10) || 'A. ' || substr(text, 1, 5) || chr(10) || 'B. ' || item_id || chr(10) || 'Answer:' AS prompt FROM benchmark) SELECT item_id, length(prompt)::INTEGER AS n, substr(sha256(prompt), 1, 16) AS hash FROM p")
def prompts(spark, sf_dir):
    labels, texts = F.array(F.lit("A"), F.lit("B")), F.array(F.substring("text", 1, 5), F.col("item_id").cast("string"))
    p = table(spark, sf_dir, "benchmark").select("item_id", text.render_prompt(F.col("text"), labels, texts).alias("prompt"))
    return p.select("item_id", F.length("prompt").alias("n"), text.short_hash(F.col("prompt")).alias("hash"))


@query("q_answer_key", "SELECT event_id, CASE WHEN k BETWEEN 1 AND 5 THEN substr('ABCDE', k::INTEGER, 1) END AS answer FROM (SELECT event_id, (props->>'k')::INTEGER % 8 AS k FROM events)")
def answer_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.answer_key((F.get_json_object("props", "$.k").cast("int") % 8).cast("string")).alias("answer"))


PAIR_SQL = "p AS (SELECT d.doc_id, d.lang, l.quality = 1 AS a, l.toxic = 0 AS b, l.quality = 1 AND d.n_chars > 300 AS scored FROM documents d JOIN labels l USING (doc_id))"


def verdicts(spark, sf_dir) -> DataFrame:
    """Documents with a label as questions answered by two sides: quality and not toxic."""
    l = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), "n_chars")
    none = F.array().cast("array<string>")
    return d.join(l.withColumnRenamed("doc_id", "id"), "id").select("id", "category", (F.col("quality") == 1).alias("source_correct"), (F.col("toxic") == 0).alias("candidate_correct"), (F.col("quality") + F.col("toxic") == 1).alias("agree"), (F.col("n_chars") > 300).alias("scored"), none.alias("source_anomalies"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(none).alias("candidate_anomalies"))


#: Turns as questions: the first check of every third is open; the source answers with the turn, the candidate with its words backwards, or not at all.
PAIRED_SQL = f"""WITH q AS (SELECT conv_id || '-' || turn AS id, role AS category, turn % 3 <> 0 AS scored, text AS a, CASE WHEN turn % 5 = 4 THEN ' ' ELSE array_to_string(list_reverse(string_split(text, ' ')), ' ') END AS b FROM conversations),
s AS (SELECT id, 'a' AS side, a AS raw FROM q UNION ALL SELECT id, 'b', b FROM q), f AS (SELECT id, side, id || side AS x, raw, {final_sql('raw')} AS final FROM s), z AS ({loop_sql('f', 'x', 'final')}),
v AS (SELECT id, side, {norm_sql('final')} AS n, {anomalies_sql('raw', 'final', 'false', 'loops')} AS an FROM f JOIN z USING (x)),
w AS (SELECT q.*, v.n AS n1, w.n AS n2, len(v.an) AS c1, len(w.an) AS c2, len(v.an) = 0 AND (NOT scored OR contains(v.n, 'laen') OR contains(v.n, 'the')) AS ok1, len(w.an) = 0 AND (NOT scored OR contains(w.n, 'laen') OR contains(w.n, 'the')) AS ok2 FROM q JOIN v ON v.id = q.id AND v.side = 'a' JOIN v w ON w.id = q.id AND w.side = 'b')
"""


def paired_turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("category"), "turn", "text")
    checks = F.when(F.col("turn") % 3 == 0, F.array(one_check("open"))).otherwise(F.array(one_check("contains", ["la en"]), one_check("contains", ["The"])))
    questions = normal_checks(c.select("id", "category", checks.alias("checks")))
    back = F.when(F.col("turn") % 5 == 4, " ").otherwise(F.array_join(F.reverse(F.split("text", " ")), " "))
    runs = lambda raw: c.select("id", raw.alias("raw_output"), F.lit(False).alias("truncated"))
    return scoring.paired(questions, runs(F.col("text")), runs(back), partial=True)


@query("q_eval_pairing", PAIRED_SQL + "SELECT id, category, scored, ok1 AS source_correct, ok2 AS candidate_correct, n1 = n2 AS agree, c1::INTEGER AS source_anomalies, c2::INTEGER AS candidate_anomalies FROM w")
def pairing(spark, sf_dir):
    """Questions joined with both sides' runs, whose outputs are finished, normalised, searched for anomalies and checked."""
    p = paired_turns(spark, sf_dir)
    return p.select("id", "category", "scored", "source_correct", "candidate_correct", "agree", F.size("source_anomalies").alias("source_anomalies"), F.size("candidate_anomalies").alias("candidate_anomalies"))


@query("q_changed_verdicts", PAIRED_SQL + "SELECT id FROM w WHERE NOT scored AND (c1 = 0 AND NOT contains(n1, 'tion') OR c2 = 0 AND NOT contains(n2, 'tion'))")
def changed(spark, sf_dir):
    """Stored items judged again after open questions got a check."""
    items = paired_turns(spark, sf_dir)
    stricter = items.withColumn("checks", F.when(F.col("scored"), F.col("checks")).otherwise(F.array(one_check("contains", ["tion"]))))
    return scoring.changed_verdicts(items, scoring.judged(stricter)).select("id")


@query("q_run_parameters", "SELECT event_type AS side, count(DISTINCT (user_id % 3, event_id % 2))::INTEGER AS settings FROM events GROUP BY ALL")
def run_parameters(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("side"), (F.col("user_id") % 3).cast("int").alias("max_tokens"), (F.col("event_id") % 2).cast("double").alias("temp"))
    return scoring.parameters(runs).select("side", F.size("settings").alias("settings"))


@query("q_generation_bar", f"SELECT lang, bool_and({strip_sql('text')} <> '') AND bool_and(CASE WHEN length(text) = 0 THEN 0 ELSE length(regexp_replace(text, '{UNPRINTABLE_SQL}', '', 'g')) / length(text)::DOUBLE END > 0.9) AND max(length(text)) >= 30 AS passed FROM documents GROUP BY ALL")
def generation_bar(spark, sf_dir):
    return scoring.generation_bar(table(spark, sf_dir, "documents").select("lang", F.col("text").alias("output")), ["lang"])


@query("q_flips", "SELECT doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE n_chars > 300 AND (quality = 1) <> (toxic = 0)")
def flips(spark, sf_dir):
    return scoring.flips(verdicts(spark, sf_dir))


@query("q_verdict_agreement", """SELECT count(*) AS n_questions, count(*) FILTER (n_chars > 300) AS n_scored, round(avg(quality) FILTER (n_chars > 300), 6) AS source_accuracy, round(avg((toxic = 0)::INTEGER) FILTER (n_chars > 300), 6) AS candidate_accuracy, round(avg((quality + toxic = 1)::INTEGER), 6) AS agreement,
round(avg(((quality = 1) = (toxic = 0))::INTEGER) FILTER (n_chars > 300), 6) AS verdict_agreement, round(avg(toxic), 6) AS candidate_anomaly_rate, count(*) FILTER (n_chars > 300 AND (quality = 1) <> (toxic = 0)) AS flips FROM documents JOIN labels USING (doc_id)""")
def agreement(spark, sf_dir):
    s = scoring.summary(verdicts(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return s.select("n_questions", "n_scored", r("source_accuracy"), r("candidate_accuracy"), r("agreement"), r("verdict_agreement"), r("candidate_anomaly_rate"), F.col("n_flips").alias("flips"))


@query("q_category_table", "SELECT lang AS category, count(*) FILTER (quality = 1) AS source_correct, count(*) FILTER (toxic = 0) AS candidate_correct, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE n_chars > 300 GROUP BY ALL")
def categories(spark, sf_dir):
    return scoring.by_category(verdicts(spark, sf_dir))


@query("q_last_record_wins", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_wins(spark, sf_dir):
    """Of records of the same id, the last one counts."""
    return records.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], ["event_id"]).drop("event_id")


@query("q_duplicate_ids", "SELECT user_id AS id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return records.duplicates(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")))


@query("q_choice_set", "SELECT item_id AS id, 'A,B,C' AS labels, array_to_string([substr(text, 1, 4), substr(text, 5, 4), substr(text, 9, 4)], '|') AS texts, CASE item_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'A' END AS answer_key FROM benchmark WHERE item_id % 4 <> 3 AND item_id % 5 <> 0")
def choice_set(spark, sf_dir):
    """Items as choice questions: labels in several styles, keys as digits or letters, some of them unusable, some without texts."""
    k = F.col("item_id") % 4
    texts = F.when(F.col("item_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(*[F.substring("text", i, 4) for i in (1, 5, 9)]))
    choices = F.struct(F.array(F.lit("(a)"), F.lit("2"), F.lit(" C.")).alias("label"), texts.alias("text")).alias("choices")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), choices, F.when(k == 0, "2").when(k == 1, " c ").when(k == 2, "A").otherwise("7").alias("answerKey"))
    return records.choice_set(rows).select("id", F.array_join("labels", ",").alias("labels"), F.array_join("texts", "|").alias("texts"), "answer_key")


@query("q_manifest_totals", "SELECT count(*) AS files, sum(length(text))::BIGINT AS total_bytes FROM documents")
def totals(spark, sf_dir):
    return records.manifest_totals(table(spark, sf_dir, "documents").select(F.length("text").cast("bigint").alias("size")))


@query("q_asset_revisions", "SELECT p_partkey, coalesce(r.v, 'stated') AS revision FROM part LEFT JOIN (SELECT ps.p_brand AS b, max(ps.p_name) AS v FROM part ps WHERE ps.p_size > 40 AND ps.p_brand < 'Brand#40' GROUP BY ALL) r ON r.b = p_brand")
def revisions(spark, sf_dir):
    """Parts as assets whose brand is their repository; large parts of some brands record a revision."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "repo")
    log = p.where("p_size > 40 AND repo < 'Brand#40'").select("repo", F.col("p_name").alias("revision"))
    return records.with_revision(p.select("p_partkey", "repo", F.lit("stated").alias("revision")), log).select("p_partkey", "revision")


MC_SQL = """r AS (SELECT event_type AS side, event_id AS id, substr('ABCDE', (user_id % 5)::INTEGER + 1, 1) AS answer_key, CASE WHEN value < 1 THEN NULL ELSE substr('ABCDE', (event_id % 5)::INTEGER + 1, 1) END AS letter, value > 100 AS truncated, (props->>'k')::INTEGER > 70 AS repetition, value AS gen_s, (props->>'k')::INTEGER % 4 = 0 AS extra FROM events),
a AS (SELECT *, (letter IS NULL)::INTEGER + (repetition AND truncated)::INTEGER + (truncated AND letter IS NULL)::INTEGER AS odd FROM r),
s AS (SELECT side, count(*) AS n, avg((letter IS NOT DISTINCT FROM answer_key)::INTEGER) AS accuracy, avg((letter IS NOT DISTINCT FROM answer_key AND odd = 0)::INTEGER) AS clean_accuracy, avg((odd > 0)::INTEGER) AS anomaly_rate, sum(odd)::BIGINT AS anomaly_events, avg((letter IS NOT NULL AND NOT extra)::INTEGER) AS letter_only_compliance, round(median(gen_s), 3) AS median_gen_s, round(sum(gen_s), 1) AS total_gen_s FROM a GROUP BY ALL)"""


def choice_runs(spark, sf_dir) -> DataFrame:
    """Events as multiple-choice runs: the event type is the side, the value the seconds."""
    nth = lambda c: F.substring(F.lit("ABCDE"), (c % 5).cast("int") + 1, F.lit(1))
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("side"), F.col("event_id").alias("id"), nth(F.col("user_id")).alias("answer_key"), F.when(v < 1, F.lit(None)).otherwise(nth(F.col("event_id"))).alias("letter"), F.lit("x").alias("raw_output"), (v > 100).alias("truncated"), (k > 70).alias("repetition"), v.alias("gen_s"), (k % 4 == 0).alias("extra_text"))


@query("q_mc_side_score", f"WITH {MC_SQL} SELECT side, n, round(accuracy, 6) AS accuracy, round(clean_accuracy, 6) AS clean_accuracy, round(anomaly_rate, 6) AS anomaly_rate, anomaly_events, round(letter_only_compliance, 6) AS letter_only_compliance, median_gen_s, total_gen_s FROM s")
def side_scores(spark, sf_dir):
    s = scoring.choice_scores(choice_runs(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) if c in ("accuracy", "clean_accuracy", "anomaly_rate", "letter_only_compliance") else F.col(c) for c in s.columns])


@query("q_promotion_gate", f"WITH {MC_SQL}, b AS (SELECT clean_accuracy AS ba, anomaly_rate AS br FROM s WHERE side = 'view') SELECT side, round((ba - clean_accuracy) * 100, 2) AS accuracy_gap_pp, round((anomaly_rate - br) * 100, 2) AS anomaly_gap_pp, CASE WHEN side <> 'view' THEN (ba - clean_accuracy) * 100 <= 5.0 AND (anomaly_rate - br) * 100 <= 2.0 END AS passed FROM s, b")
def gate(spark, sf_dir):
    return scoring.gate(scoring.choice_scores(choice_runs(spark, sf_dir)), "view").select("side", "accuracy_gap_pp", "anomaly_gap_pp", "passed")


@query("q_report_choice", f"WITH {MC_SQL}, b AS (SELECT clean_accuracy AS ba, anomaly_rate AS br FROM s WHERE side = 'view') SELECT 'sides.' || side || '.n' AS path, n::VARCHAR AS value FROM s UNION ALL SELECT 'sides.' || side || '.passed', CASE WHEN side <> 'view' THEN ((ba - clean_accuracy) * 100 <= 5.0 AND (anomaly_rate - br) * 100 <= 2.0)::VARCHAR END FROM s, b UNION ALL SELECT 'source', 'view' UNION ALL SELECT 'heading', '## sides'")
def report_choice(spark, sf_dir):
    """The report of a choice evaluation, written as JSON and Markdown and read back."""
    report = reports.choice(choice_runs(spark, sf_dir), "view")
    held = json.loads(reports.to_json(report))
    lines = [x for x in reports.to_markdown(report, "t").split("\n") if x == "## sides"]
    out = [("source", held["source"]), *[("heading", x) for x in lines]]
    for side in held["sides"]:
        out += [(f"sides.{side['side']}.n", str(side["n"])), (f"sides.{side['side']}.passed", None if side["passed"] is None else str(side["passed"]).lower())]
    return spark.createDataFrame(out, "path string, value string")


@query("q_report_evaluation", "SELECT 'summary.n_scored' AS path, count(*) FILTER (n_chars > 300)::VARCHAR AS value FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'categories.' || lang, count(*)::VARCHAR FROM documents JOIN labels USING (doc_id) WHERE n_chars > 300 GROUP BY lang UNION ALL SELECT 'candidate_anomalies.toxic', count(*)::VARCHAR FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT 'flips.first', min(doc_id)::VARCHAR FROM documents JOIN labels USING (doc_id) WHERE n_chars > 300 AND (quality = 1) <> (toxic = 0)")
def report_evaluation(spark, sf_dir):
    held = json.loads(reports.to_json(reports.evaluation(verdicts(spark, sf_dir))))
    out = [("summary.n_scored", str(held["summary"]["n_scored"])), *[(f"categories.{c['category']}", str(c["n"])) for c in held["categories"]], *[(f"candidate_anomalies.{c['anomaly']}", str(c["n"])) for c in held["candidate_anomalies"]], ("flips.first", str(held["flips"][0]))]
    return spark.createDataFrame(out, "path string, value string")


@query("q_side_consistency", "SELECT user_id AS id, CASE WHEN count(DISTINCT event_type) < 5 THEN 'coverage' WHEN count(DISTINCT value > 100) > 1 THEN 'answer key' END AS problem FROM events GROUP BY ALL HAVING problem IS NOT NULL")
def consistency(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("side"), (F.col("value") > 100).cast("string").alias("answer_key"), F.lit("h").alias("prompt_sha256"))
    return scoring.side_problems(runs)


@query("q_gen_timing_stats", "SELECT event_type, round(sum(value), 1) AS total_s, round(avg(value), 2) AS mean_s, round(median(value), 2) AS median_s FROM events GROUP BY ALL")
def timing(spark, sf_dir):
    return scoring.timings(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("q_status_rollup", "SELECT user_id, CASE WHEN bool_and(event_type <> 'error') THEN 'PASS' ELSE 'FAIL' END AS status, count(*) FILTER (event_type <> 'error') AS n_pass, count(*) AS n FROM events GROUP BY ALL")
def status(spark, sf_dir):
    stages = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS").alias("status"))
    return scoring.rollup(stages, ["user_id"])


@query("q_token_windows", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t FROM documents), n AS (SELECT *, greatest((len(t) - 1) // 64, 0) AS k FROM w) SELECT doc_id, k::INTEGER AS windows, CASE WHEN k > 0 THEN t[(k - 1) * 64 + 1] END AS last_first FROM n")
def windows(spark, sf_dir):
    w = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", calibration.token_windows(w, 64).alias("w"))
    n = F.size("w")
    return d.select("doc_id", n.alias("windows"), F.when(n > 0, F.get(F.get("w", n - 1), F.lit(0))).alias("last_first"))


@query("q_continuation_logprob", """WITH e AS (SELECT vec_id, embedding AS v FROM embeddings), l AS (SELECT vec_id, list_transform(v, lambda x: x::DOUBLE - ln(list_sum(list_transform(v, lambda y: exp(y::DOUBLE))))) AS lp FROM e)
SELECT vec_id // 4 AS id, round(sum(lp[(vec_id % 64)::INTEGER + 1]), 6) AS total FROM l GROUP BY ALL""")
def continuation(spark, sf_dir):
    """Rows of the embeddings as logits of four positions of a continuation each."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("bigint").alias("id"), F.lit("A").alias("option"), (F.col("vec_id") % 4).alias("pos"), calibration.log_softmax(F.col("embedding")).alias("lp"), "vec_id")
    tokens = e.select("id", "option", F.col("pos").alias("at"), (F.col("vec_id") % 64).alias("token"))
    return calibration.continuation(e.select("id", "option", "pos", "lp"), tokens).select("id", F.round("total", 6).alias("total"))


@query("q_choice_margin", """WITH o AS (SELECT vec_id, unnest(embedding[1:5])::DOUBLE AS s, generate_subscripts(embedding[1:5], 1) AS i, label % 5 + 1 AS a FROM embeddings)
SELECT count(DISTINCT vec_id) AS n_questions, round(avg(r), 6) AS accuracy, round(avg(m), 5) AS margin FROM (SELECT vec_id, (arg_max(i, s) = any_value(a))::INTEGER AS r, max(s) FILTER (i = a) - max(s) FILTER (i <> a) AS m FROM o GROUP BY vec_id)""")
def margin(spark, sf_dir):
    letter = lambda c: F.substring(F.lit("ABCDE"), c.cast("int") + 1, F.lit(1))
    o = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.posexplode(F.slice("embedding", 1, 5)).alias("i", "s"))
    scores = o.select("id", letter(F.col("i")).alias("option"), letter(F.col("label") % 5).alias("answer"), F.col("s").cast("double").alias("score"))
    m = calibration.choice_metrics(scores, scores)
    return m.select("n_questions", F.round("mc_letter_acc", 6).alias("accuracy"), F.round("mean_letter_margin", 5).alias("margin"))


@query("q_subset_positions", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS at FROM documents")
def subset_positions(spark, sf_dir):
    return records.positions(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "at")


@query("q_subset_hash", "SELECT sha256(string_agg('{\"doc_id\":' || doc_id || ',\"quality\":' || quality || ',\"toxic\":' || toxic || '}', chr(10) ORDER BY doc_id)) AS hash, count(*) AS n FROM labels")
def subset_hash(spark, sf_dir):
    """The hash of all labels as a set of questions."""
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return l.agg(F.lit(records.subset_hash(l, "doc_id")).alias("hash"), F.count("*").alias("n"))


@query("q_subset_draw", "SELECT (SELECT count(*) FROM benchmark) // 3 AS n, true AS among, true AS again")
def subset_draw(spark, sf_dir):
    """A third of the benchmark drawn by a seed: as many as asked for, all from the table, the same ones every time."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    n = b.count() // 3
    one, two = records.subset(b, n, 7), records.subset(b.repartition(5), n, 7).withColumnRenamed("id", "other")
    both = one.join(two, F.col("id") == F.col("other"), "full_outer").join(b.withColumnRenamed("id", "whole"), F.col("id") == F.col("whole"), "left")
    return both.agg(F.count("id").alias("n"), F.bool_and(F.col("whole").isNotNull()).alias("among"), F.bool_and(F.col("other").isNotNull() & F.col("id").isNotNull()).alias("again"))
