"""Passages of held-out test items inside a training corpus."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

WORD = re.compile("[a-z0-9]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of a-z and 0-9 after lower-casing."""
    return WORD.findall(text.lower()) if text else []


class ItemAutomaton:
    """Generalised suffix automaton over the words of test items.

    A state stands for all word sequences with one set of end positions; `length` is the longest of them and `link` the state
    of the longest proper suffix with other end positions. `holders` has the items in which a state's sequences occur, for
    states of `min_words` words or more; `whole` has the shorter items that are found complete, as (words, item).
    """

    def __init__(self, items: Iterable[tuple[int, list[str]]], min_words: int) -> None:
        self.min_words, self.vocabulary = min_words, {}
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: list[int] = []
        self.sizes: list[int] = []
        coded = []
        for item, words in items:
            if words:
                self.ids.append(item)
                self.sizes.append(len(words))
                coded.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
        for code in coded:
            state = 0
            for word in code:
                state = self._extend(state, word)
        self.holders: list[list[int]] = [[] for _ in self.link]
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.link]
        marked = [-1] * len(self.link)
        for number, code in enumerate(coded):
            state = 0
            for word in code:
                state = at = self.follow[state][word]
                while self.length[at] >= min_words and marked[at] != number:
                    marked[at] = number
                    self.holders[at].append(number)
                    at = self.link[at]
            if len(code) < min_words:
                self.whole[state].append((len(code), number))
        #: The different lengths of a state's complete items, the longest first.
        self.whole_sizes = [sorted({words for words, _ in held}, reverse=True) for held in self.whole]
        #: The nearest state on the way up the links, itself included, that has a complete short item.
        self.next_whole = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.next_whole[state] = state if self.whole[state] else self.next_whole[self.link[state]]
        #: No run of known words shorter than this can be a case.
        self.shortest = min([min_words, *self.sizes])

    def _extend(self, last: int, word: int) -> int:
        follow, link, length = self.follow, self.link, self.length
        known = follow[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is None:
            new = self._state(length[last] + 1, {})
            at = last
            while at >= 0 and word not in follow[at]:
                follow[at][word] = new
                at = link[at]
            link[new] = 0 if at < 0 else self._split(at, word)
            return new
        return self._split(last, word)

    def _state(self, length: int, follow: dict[int, int]) -> int:
        self.follow.append(follow)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, at: int, word: int) -> int:
        """The state of `at`'s longest sequence followed by `word`, cut out of a state with longer ones if need be."""
        target = self.follow[at][word]
        if self.length[target] == self.length[at] + 1:
            return target
        copy = self._state(self.length[at] + 1, dict(self.follow[target]))
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while at >= 0 and self.follow[at].get(word) == target:
            self.follow[at][word] = copy
            at = self.link[at]
        return copy

    def scan(self, words: list[str]) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """The items found in a text, each with its longest match in words, and the matched spans [from, to) of the text."""
        found: dict[int, int] = {}
        spans: list[tuple[int, int]] = []
        get = self.vocabulary.get
        code = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        unknown = np.flatnonzero(code < 0)
        gaps = np.diff(np.concatenate([[-1], unknown, [len(words)]])) - 1
        begins = np.concatenate([[0], unknown + 1])
        reached: dict[int, int] = {}
        for k in np.flatnonzero(gaps >= self.shortest):
            begin = int(begins[k])
            self._scan_run(code[begin : begin + int(gaps[k])].tolist(), begin, reached, spans)
        self._resolve(reached, found)
        return found, spans

    def _scan_run(self, code: list[int], begin: int, reached: dict[int, int], spans: list[tuple[int, int]]) -> None:
        """Adds the states that a run of known words reaches, each with its longest match, and the matched spans."""
        follow, link, length, least, shortest = self.follow, self.link, self.length, self.min_words, self.shortest
        state = size = 0
        for place, word in enumerate(code, begin + 1):
            onward = follow[state].get(word)
            while onward is None and state:
                state = link[state]
                size = length[state]
                onward = follow[state].get(word)
            if onward is None:
                continue
            state, size = onward, size + 1
            if size < shortest:
                continue
            if reached.get(state, 0) < size:
                reached[state] = size
            if size >= least:
                spans.append((place - size, place))
                continue
            at = self.next_whole[state]
            while at:
                words = next((w for w in self.whole_sizes[at] if w <= size), 0)
                if words:
                    spans.append((place - words, place))
                    break
                at = self.next_whole[link[at]]

    def _resolve(self, reached: dict[int, int], found: dict[int, int]) -> None:
        """Adds the items that the reached states and those up their links stand for; a state is looked up once a text, however often the text reaches it."""
        done: set[int] = set()
        for state, match in reached.items():
            at = state
            while at and at not in done:
                if match >= self.min_words:
                    for item in self.holders[at]:
                        if found.get(item, 0) < match:
                            found[item] = match
                for words, item in self.whole[at]:
                    if words <= match:
                        found[item] = words
                if match == self.length[at]:
                    done.add(at)  # and with it all up its links
                at = self.link[at]
                match = self.length[at]


def _automata(items: DataFrame, item_id: str, text: str, min_words: int, block_words: int) -> Iterator[ItemAutomaton]:
    """Automata over blocks of items of at most `block_words` words (a longer item stands alone)."""
    block: list[tuple[int, list[str]]] = []
    total = 0
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).dropna().dropDuplicates().orderBy("i", "t")
    for row in rows.toLocalIterator():
        words = words_of(row["t"])
        if block and total + len(words) > block_words:
            yield ItemAutomaton(block, min_words)
            block, total = [], 0
        if words:
            block.append((row["i"], words))
            total += len(words)
    if block:
        yield ItemAutomaton(block, min_words)


def find_leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
               min_words: int = 13, block_words: int = 300_000) -> DataFrame:
    """(item_id, doc_id, longest_words, item_words): the items of which each document holds a passage.

    Words are runs of a-z and 0-9 after lower-casing, so punctuation, case and line breaks don't hide a passage. Item and
    document are a case if they share at least `min_words` consecutive words, or all words of a shorter item. Items and
    documents that are null, empty or without a word are no case. Repeated items or documents give one row for each pair of
    ids; other columns may have any name. Texts are read whole. Empty tables give an empty result.

    The items make a suffix automaton, a stated query set of at most `block_words` words in a block, and each block is
    broadcast (about 100 bytes a word, so 30 MB); further blocks make further passes. Documents stream through it where
    they lie: no shuffle but for distinct pairs. Runs of words that no item has are skipped without entering the automaton.
    """
    out = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("doc_id", documents.schema[doc_id].dataType),
                        T.StructField("longest_words", T.IntegerType()), T.StructField("item_words", T.IntegerType())])
    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    spark, result = documents.sparkSession, documents.sparkSession.createDataFrame([], out)
    read = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    for automaton in _automata(items, item_id, text, min_words, block_words):
        shared = spark.sparkContext.broadcast(automaton)

        def scan(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                rows = [(known.ids[i], d, n, known.sizes[i]) for d, t in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), strict=True)
                        for i, n in known.scan(words_of(t))[0].items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=out.names)

        result = result.union(read.mapInArrow(scan, out))
    return result.groupBy("item_id", "doc_id").agg(F.max("longest_words").alias("longest_words"), F.max("item_words").alias("item_words"))


def _offsets(text: str) -> tuple[str, list[int] | None]:
    """The lower-cased text, and for each of its characters the one of `text` it comes from, if they aren't the same."""
    lowered = text.lower()
    if len(lowered) == len(text):
        return lowered, None
    return lowered, [i for i, c in enumerate(text) for _ in c.lower()]


def cut_spans(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """`text` without the characters from the first to the last word of each span of words, and the number of words cut."""
    lowered, origin = _offsets(text)
    places = [m.span() for m in WORD.finditer(lowered)]
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        begin, end = places[a][0], places[b - 1][1]
        if origin:
            begin, end = origin[begin], origin[end - 1] + 1
        kept.append(text[at:begin])
        at = end
    return "".join([*kept, text[at:]]), sum(b - a for a, b in merged)


def remove_leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
                 min_words: int = 13, max_coverage: float = 0.5, block_words: int = 300_000) -> DataFrame:
    """(doc_id, clean_text, leaked_words, n_words, drop) of every document that holds a passage of a test item.

    Passages are those of `find_leaks`; each is cut from the text from its first to its last word. `drop` is set where more
    than `max_coverage` of the words were cut. Other documents stay as they are and have no row. Items that make more than
    one block of `block_words` words are cut in one pass by several automata, all held at once.
    """
    out = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("clean_text", T.StringType()),
                        T.StructField("leaked_words", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("drop", T.BooleanType())])
    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    context = documents.sparkSession.sparkContext
    shared = [context.broadcast(a) for a in _automata(items, item_id, text, min_words, block_words)]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), strict=True):
                words = words_of(t)
                spans = [s for a in shared for s in a.value.scan(words)[1]]
                if spans:
                    clean, n = cut_spans(t, spans)
                    rows.append((d, clean, n, len(words), n > max_coverage * len(words)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=out.names)

    read = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    return read.mapInArrow(cut, out)
