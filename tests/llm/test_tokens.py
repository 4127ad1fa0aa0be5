import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import common, packing, token_counts

LIBRARY = Tokenizer.from_file(common.tokenizer_path())


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def texts(n=60):
    r = random.Random(3)
    some = [None, "", " \n", "a", "<|endoftext|>", "x<|startoftext|>y <|endoftext|> z", "It's  they'll 12345 a1b2 ΣΑΣ Σ", "é ́a \xa0b c \x1cd\x85e​f", "😀😀 \x00 ñandú", "ﬁ Å Å", "word " * 9000, "q" * 5000]
    return some + ["".join(r.choice("abc def\n'<|>éß日1😀\t") for _ in range(r.randint(1, 400))) for _ in range(n)]


def test_counts_match_the_library(spark, docs):
    rows = list(enumerate(texts()))
    got = {r.id: r for r in token_counts.token_counts(docs(rows)).collect()}
    for i, t in rows:
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048), t
        cut = (t or "").encode()[: got[i].fit_bytes]
        assert len(ids(cut.decode())) <= 2048


@pytest.mark.parametrize("memory", [600_000, 300])
def test_random_strings_match_the_library(monkeypatch, memory):
    monkeypatch.setattr(token_counts, "MEMORY", memory)
    monkeypatch.setattr(token_counts, "IDLE_MEMORY", memory // 3)
    r, tokens = random.Random(12), token_counts.WordTokens(common.tokenizer_path())
    letters = "abcİıIßſKÅΣσς.,;:!?'\" \t\n-_#<|>0123½²Ⅷ①é\u0301日本ñÑÄ\xa0\u200bﬁ😀ǅŉẞ\u0345\u037e。"
    lines = ["".join(r.choice(letters) for _ in range(r.randint(1, 14))) + r.choice(["", " İ.", "<|endoftext|>", " é!"]) for _ in range(20_000)]
    for t, (_, parts) in zip(lines, tokens.of_texts([t.encode() for t in lines], most=4 << 20 if memory > 300 else 2000), strict=True):
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == ids(t), t


def test_letters_that_composing_or_lower_case_changes(spark, docs):
    rows = list(enumerate(x + m for x in ("\u0958", "a\u09dc", "\u0a36", "\u0f43", "\ufb2a", "\u0130", "T\u0308", "I\u0324\u0307", "J\u030c", "T\u0344", "e", "é", "5", "\xa0", "a\xa0", "日", "'", "it's", "a<", "<|endoftext|>", "") for m in (".", ",!", "$$$", ".&&&", '")', "-", "'.", "|>.", "")))
    check_packing(rows, packing.pack(docs(rows)).collect())
    got = {r.id: r.n_tokens for r in token_counts.token_counts(docs(rows)).collect()}
    assert got == {i: len(ids(t)) for i, t in rows}


def test_words_are_learned_without_the_marks_that_follow():
    tokens = token_counts.WordTokens(common.tokenizer_path())
    library, calls = tokens.library, []

    class Counting:
        def encode(self, text, **how):
            calls.append(text)
            return library.encode(text, **how)

    tokens.library = Counting()
    words = ["q" + a + b + c for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]
    text = " ".join(w + m for w in words for m in ("", ".", ",", "$$$", ".&&&", ')"'))
    assert np.frombuffer(tokens.text_ids(text.encode()), "<u4").tolist() == ids(text)
    assert len(calls) < 50
    assert set(tokens.ids) == {w.encode() for w in words} | {b"", b".", b",", b"$$$", b".&&&", b')"'}


def test_every_prefix_is_exact():
    tokens = token_counts.word_tokens(common.TOKENIZER_FILE)
    for t in texts(10):
        if t and len(t) < 500:
            assert token_counts.PrefixCounts(t.encode(), tokens).every() == [len(ids(t[:k])) for k in range(len(t) + 1)], t


def test_budgets_from_the_stored_table(spark, docs):
    rows = list(enumerate(texts(10)))
    stored = common.stored(token_counts.prefix_table(docs(rows)), "t")
    for budget in (0, 3, 50):
        for r in token_counts.within_budget(stored, budget).collect():
            assert len(ids((rows[r.id][1] or "").encode()[: r.fit_bytes].decode())) <= budget


def check_packing(rows, got):
    want = defaultdict(list)
    for k, t in rows:
        all_ids = [*ids(t), 0]
        for p, a in enumerate(range(0, len(all_ids), 2048)):
            part = all_ids[a : a + 2048]
            want[k].append((p, a, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    have, places = defaultdict(list), defaultdict(list)
    for r in got:
        have[r.id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for v in places.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048
    return len(places), -(-sum(p[2] for v in want.values() for p in v) // 2048)


def test_packing_is_whole_and_tight(spark, docs):
    r = random.Random(4)
    rows = list(enumerate(texts() + ["w " * min(9000, int(r.lognormvariate(5.5, 1.2))) for _ in range(400)]))
    bins, least = check_packing(rows, packing.pack(docs(rows).repartition(5)).collect())
    assert bins <= 1.02 * least + 1


def test_packing_edge_cases(spark, docs):
    assert packing.pack(docs([])).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, "w " * 2047), (3, "w " * 2048), (4, "w " * 1500), (5, "w " * 1500)]
    assert check_packing(rows, packing.pack(docs(rows)).collect())[0] == 4


def test_many_groups(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    rows = [(i, "w " * (300 + 97 * i % 1700)) for i in range(60)]
    bins, least = check_packing(rows, packing.pack(docs(rows).repartition(8)).collect())
    assert bins <= 1.3 * least
