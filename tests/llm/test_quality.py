import random
import re
from collections import Counter

from sparkloom.llm import common, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    at = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if at[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(spark, docs):
    r = random.Random(1)
    texts = [None, "", " ", "a", "\n\n", "a b c d e a b c d e", "x " * 40, "\xa0 é#\x0b|\x0c $ \r\n \r\n a\na\n", "\U0001f600 b", "😀\t😀\n" * 3, " lead trail "]
    texts += ["".join(r.choice("ab c\nd\t#é\x1c ") for _ in range(r.randint(1, 300))) for _ in range(80)] + ["w%d " % (i % 7) * 2000 for i in range(2)]
    got = {x.doc_id: tuple(x)[1:6] for x in quality.with_counts(docs(list(enumerate(texts))), out="").select("doc_id", *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_outliers_go_and_clean_documents_stay(spark, docs):
    r = random.Random(2)
    clean = [(i, " ".join(f"w{r.randint(0, 10**6)}" for _ in range(80)), r.choice(["en", None]), "s") for i in range(120)]
    junk = [(1000, " ".join(f"w{r.randint(0, 10**6)} ###" for _ in range(80))), (1001, "one two"), (1002, None), (1003, "a b c d e " * 30)]
    df = docs(clean + junk)
    kept = {x.doc_id for x in quality.quality_filter(df.withColumn("q_kept", df.doc_id)).collect()}
    assert kept == {x[0] for x in clean}


def test_empty_table(spark, docs):
    assert quality.quality_filter(docs([])).count() == 0


def test_sketch_does_not_depend_on_partitions(spark, docs):
    df = quality.with_counts(docs([(i, f"a{i} b " * (i % 9 + 6) + "#" * (i % 5)) for i in range(200)]))
    rows = [sorted(map(tuple, quality.thresholds(df.repartition(n)).collect())) for n in (1, 7)]
    assert rows[0] == rows[1]


def test_bounds_without_broadcast(spark, docs, monkeypatch):
    df = quality.with_counts(docs([(i, f"a{i} b c d e f g h i j k", None if i % 2 else "en", "s") for i in range(20)]))
    one = sorted(map(tuple, quality.judged(df).collect()), key=str)
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", -1)
    assert one == sorted(map(tuple, quality.judged(df).collect()), key=str)
    assert common.SPACE[0] == " "
