"""Exact token counts at every prefix of a text, by dynamic programming over its words.

The vocabulary drops white space and never merges across it, so the count of a prefix is the count
up to the last complete word plus the count of the part of a word that follows.  The first comes
from a running sum, the second from a table of the word's own prefixes; both are exact because each
distinct word, or part of one, is encoded by the library itself and remembered.  Once the sums are
stored, questions about truncation and budgets need no encoding of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache, cached_property
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 2048
#: Words remembered by one worker at most, and by one that idles between tasks.
MEMORY, IDLE_MEMORY = 600_000, 200_000
#: Marks of ASCII that may end a word: with one another they form one token or more, never with letters or digits.
#: Not those of special strings, nor the apostrophe, which takes letters.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"

#: What keeps a text's capitals: special strings, and the marks that a small letter may join where its capital doesn't,
#: for the vocabulary composes before it lowers (T and U+0308 stay two, t and U+0308 are one).
CASED = "|".join(["<\\|", *"\u0307\u0308\u030a\u030c\u0331\u0344"])


def spread(words: pa.Array) -> list[bytes]:
    """The words, which have no spaces; faster than one by one."""
    if not len(words):
        return []
    together = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
    return pc.binary_join(together, pa.scalar(" ", words.type))[0].as_buffer().to_pybytes().split(b" ")


class WordTokens:
    """The ids of the words of texts, each distinct word encoded once.

    A word is what stands between white space.  Full stops and the like that follow a letter or digit
    form tokens of their own, so they are split off, and what is remembered is words without them.  Whether
    they do so after a character is asked of the library, once for each: the vocabulary sees composed text in
    lower case, so some letters (U+0130, U+0958) turn into a letter and a mark that joins the full stop.
    Words of letters alone end in exactly one token that marks a word's end, so many of them are encoded
    in one call and told apart by that mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.ids: dict[bytes, bytes] = {}
        self.apart: dict[str, bool] = {}

    def encode(self, word: bytes) -> bytes:
        return np.asarray(self.library.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode_letters(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that consist of letters."""
        out = []
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            ids = np.asarray(self.library.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(part) and at[-1] == len(ids):
                data, cuts = ids.tobytes(), (4 * at).tolist()
                out += [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
            else:
                out += map(self.encode, part)
        return out

    def stands_apart(self, last: str) -> bool:
        """Whether marks that follow this character, or none, have tokens of their own: they end a word more then."""
        if last not in self.apart:
            before, after = (self.ends[np.frombuffer(self.encode(x.encode()), "<u4")].sum() for x in (last, last + "."))
            self.apart[last] = bool(after > before)
        return self.apart[last]

    def words(self, text: bytes) -> list[bytes]:
        """The words, in lower case unless that may change their ids."""
        return (text if re.search(CASED.encode(), text) else text.lower()).split()

    def learn(self, words: list[bytes]) -> None:
        """Make sure that ``ids`` has every one of the words."""
        new = {w for w in words if w not in self.ids}
        if len(self.ids) + len(new) > MEMORY:
            self.forget(IDLE_MEMORY)
            new = {w for w in words if w not in self.ids}
        letters = [w for w in new if w.isalpha() or not w.isascii() and w.decode().isalpha()]  # bytes.isalpha holds for ASCII letters alone
        self.ids.update(zip(letters, self.encode_letters(letters), strict=True))
        for w in new.difference(letters):
            self.ids[w] = self.encode(w)

    def word_ids(self, word: bytes) -> bytes:
        got = self.ids.get(word)
        return self.encode(word) if got is None else got

    def word_count(self, word: bytes) -> int:
        return len(self.word_ids(word)) // 4

    def of_column(self, texts: pa.Array, end: bytes = b"") -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(ids of the distinct words, which of them each word is, where each text's words begin and the last one's end).

        Every text ends with one empty word, whose ids are ``end``: it gets a space at its end and loses those
        before it, and is split at white space.  A null text is empty.
        """
        texts = pc.fill_null(texts.cast(pa.large_string(), safe=False), "")
        spaced = pc.ascii_ltrim_whitespace(pc.binary_join_element_wise(texts, *pa.array(["", " "], pa.large_string())))
        # Lower case after the copy: pyarrow 23 mixes up the texts of a slice that was cast.
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(spaced, CASED), spaced, pc.ascii_lower(spaced)))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        bare = pc.ascii_rtrim(words, MARKS)
        marked = pc.not_equal(pc.binary_length(bare), pc.binary_length(words))
        last = pc.utf8_slice_codeunits(bare.filter(marked), -1).dictionary_encode()
        apart = marked.to_numpy(zero_copy_only=False).copy()
        apart[apart] = np.fromiter(map(self.stands_apart, last.dictionary.to_pylist()), bool, len(last.dictionary))[last.indices.to_numpy()]
        bare, at = pc.if_else(pa.array(apart), bare, words), np.flatnonzero(apart)
        tails = [w[n:] for w, n in zip(spread(words.take(pa.array(at))), pc.binary_length(bare).to_numpy()[at].tolist(), strict=True)]
        bare = spread(bare)
        self.learn([*bare, *set(tails)])
        ids = list(map(self.ids.__getitem__, bare))
        for k, x in zip(at.tolist(), tails, strict=True):
            ids[k] += self.ids[x]
        if ids:
            ids[pc.index(words, "").as_py()] = end
        return ids, coded.indices.to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())]

    def of_texts(self, texts: list[bytes], most: int = 4 << 20) -> Iterator[tuple[bytes, list[bytes]]]:
        """(text, ids of its words) for each text; a few MB of text are learned at a time."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= most):
                size += len(texts[to])
                to += 1
            ids, which, starts = self.of_column(pa.array(texts[at:to], pa.large_binary()))
            parts, starts = list(map(ids.__getitem__, which.tolist())), starts.tolist()
            for x, a, b in zip(texts[at:to], starts, starts[1:], strict=False):
                yield x, parts[a : b - 1]
            at = to

    def text_ids(self, text: bytes) -> bytes:
        """The ids of a whole text, 4 little-endian bytes each."""
        return b"".join(next(self.of_texts([text]))[1])

    def count(self, text: bytes) -> int:
        return len(self.text_ids(text)) // 4

    def forget(self, most: int) -> None:
        """Keep the words learned first: frequent ones come early, rare ones all along."""
        if len(self.ids) > most:
            self.ids = dict(islice(self.ids.items(), most))

    def rest(self) -> None:
        """At the end of a task: an idle worker holds few words."""
        self.forget(IDLE_MEMORY)
        common.trim()


class PrefixCounts:
    """Token counts of all prefixes of one text, answering without encoding it again.

    ``sums[k]`` counts the tokens of the first k words; ``ends[k]``, found when first asked for, is the
    byte after the k-th.
    """

    def __init__(self, text: bytes, tokens: WordTokens, ids: list[bytes] | None = None):
        self.text, self.tokens = text, tokens
        words = tokens.words(text) if ids is None else ()
        self.sums = list(accumulate(map(len, ids) if ids is not None else (4 * tokens.word_count(w) for w in words), initial=0))

    @property
    def total(self) -> int:
        return self.sums[-1] // 4

    @cached_property
    def ends(self) -> list[int]:
        ends, at = [0], 0
        for w in self.text.split():
            at = self.text.index(w, at) + len(w)
            ends.append(at)
        return ends

    def at(self, n_bytes: int) -> int:
        """Tokens of the first ``n_bytes`` bytes, which must end between two characters."""
        k = bisect_right(self.ends, n_bytes) - 1
        part = self.text[self.ends[k] : n_bytes].split()
        return self.sums[k] // 4 + (self.tokens.word_count(part[0]) if part else 0)

    def fit(self, budget: int) -> int:
        """Bytes of the longest prefix made of whole words that has at most ``budget`` tokens, all if the text has."""
        return len(self.text) if self.total <= budget else self.ends[bisect_right(self.sums, 4 * budget) - 1]

    def every(self) -> list[int]:
        """The count after each character, the empty prefix first."""
        out, at = [0], 0
        for c in self.text.decode():
            at += len(c.encode())
            out.append(self.at(at))
        return out


@cache
def word_tokens(file: str) -> WordTokens:
    return WordTokens(file if "/" in file else common.tokenizer_path(file))


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def prefixes(file: str, text: str, batches) -> Iterator[tuple[pa.RecordBatch, list[PrefixCounts]]]:
    """Each piece of the batches with the prefix counts of its texts."""
    tokens = word_tokens(file)
    for b in common.pieces(batches, text):
        yield b, [PrefixCounts(x, tokens, ids) for x, ids in tokens.of_texts(raw(b.column(text)))]
    tokens.rest()


def counter(file: str, limit: int) -> Callable:
    def run(batches):
        for b, got in prefixes(file, "text", batches):
            n = [g.total for g in got]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(g.text) for g in got], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array([g.fit(limit) for g in got], pa.int64())], ["id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    return run


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str = common.TOKENIZER_FILE, limit: int = LIMIT) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit, fit_bytes (the longest prefix of whole words within the limit).

    Null text counts as empty and has no tokens; special strings inside a text get the ids the library
    gives them; ids may repeat or be null and are passed on.  No rows are moved between tasks.
    ``file`` is a vocabulary file of the public tokenizers or a path.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(common.column(key).alias("id"), common.column(text).alias("text"))
    return rows.mapInArrow(counter(file, limit), f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_bytes bigint")


def prefix_table(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str = common.TOKENIZER_FILE) -> DataFrame:
    """Per row: id, ends (byte offset after each word) and counts (tokens up to there), both starting at 0."""

    def run(batches):
        for b, got in prefixes(file, "text", batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([g.ends for g in got], pa.list_(pa.int64())), pa.array([[x // 4 for x in g.sums] for g in got], pa.list_(pa.int64()))], ["id", "ends", "counts"])

    common.small_batches(docs.sparkSession)
    rows = docs.select(common.column(key).alias("id"), common.column(text).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ends array<bigint>, counts array<bigint>")


def within_budget(prefixes: DataFrame, budget: int) -> DataFrame:
    """(id, fit_bytes) from a stored ``prefix_table``, for any budget."""
    fit = F.array_max(F.filter(F.arrays_zip("ends", "counts"), lambda e: e["counts"] <= budget))["ends"]
    return prefixes.select("id", fit.alias("fit_bytes"))
