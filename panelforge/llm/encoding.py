"""Text that was decoded under another encoding than it was written in: found, and restored where that is possible."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.storage import materialize

# Single-byte encodings under which text may have been read wrongly, those it may have been written in, and encodings of several bytes.
READ_AS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "iso8859_2", "cp1254", "mac_cyrillic", "latin_1", "cp1253", "cp1255", "cp1257", "iso8859_5", "iso8859_7", "iso8859_15")
WRITTEN_IN = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp850", "koi8_r", "cp866", "iso8859_2", "cp1253", "cp1255", "cp1257", "iso8859_5", "iso8859_7")
MULTIBYTE = ("gbk", "big5", "shift_jis", "euc_jp", "euc_kr")
#: Buckets of the hashed n-gram counts by order, and under 0 those of the trigrams of character classes: bounds of the model, whatever the corpus.
CLASSES = 17
BUCKETS = {0: CLASSES**3, 1: 1 << 16, 2: 1 << 18, 3: 1 << 21}
#: A stretch of characters beyond ASCII, with the space after it, which may have been a no-break space.
STRETCH = re.compile(r"[^\x00-\x7f]+ ?")
#: The same with ASCII characters that may be second bytes of an encoding of several bytes.
WIDE = re.compile(r"(?:[^\x00-\x7f]+[\x40-\x7e]?)+")
#: Text with a zero byte for every other one, which was written in UTF-16.
ZEROS = {"utf_16_le": re.compile("(?:[^\x00]\x00){3,}"), "utf_16_be": re.compile("(?:\x00[^\x00]){3,}")}
#: What is found out about a longer stretch isn't kept.
LONG = 64
LOST = "�"
CONTROL = re.compile("[\x80-\x9f]")


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Byte of each character beyond ASCII; bytes without a character are the control character of their number."""
    table = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    return table


@lru_cache(maxsize=None)
def _chars_of(encoding: str) -> dict[int, str]:
    return {b: c for c, b in _bytes_of(encoding).items() if not CONTROL.match(c)}


@lru_cache(maxsize=100_000)
def _choices(char: str, encoding: str) -> tuple[int, ...]:
    """Bytes that a character may stand for: its own, or that of its other case where text was re-cased after being misread."""
    table = _bytes_of(encoding)
    own = [table.get(c) for c in dict.fromkeys((char, char.upper(), char.lower())) if len(c) == 1]
    return tuple(b for b in own if b is not None)


def undo_utf8(text: str, encoding: str) -> str | None:
    """`text` with every sequence that is UTF-8 read as `encoding` decoded, or None if there is none. A space may stand for a no-break space."""
    out, at, changed, n = [], 0, False, len(text)
    while at < n:
        char = text[at]
        if char > "\x7f":
            for lead in _choices(char, encoding):
                more = 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0
                if not more or at + more >= n:
                    continue
                tail = []
                for follower in text[at + 1 : at + 1 + more]:
                    byte = 0xA0 if follower == " " else next((b for b in _choices(follower, encoding) if 0x80 <= b <= 0xBF), None)
                    if byte is None:
                        break
                    tail.append(byte)
                if len(tail) == more:
                    try:
                        out.append(bytes([lead, *tail]).decode("utf-8"))
                    except UnicodeDecodeError:
                        continue
                    at, changed = at + 1 + more, True
                    break
            else:
                out.append(char)
                at += 1
        else:
            out.append(char)
            at += 1
    return "".join(out) if changed else None


class _Strict(dict):
    """A translation of characters beyond ASCII that fails at one it doesn't have."""

    def __missing__(self, code: int) -> int:
        if code < 0x80:
            return code
        raise ValueError(code)


@lru_cache(maxsize=None)
def _to_bytes(encoding: str) -> _Strict:
    if encoding in MULTIBYTE:
        return _Strict()
    return _Strict({ord(c): b for c, b in _bytes_of(encoding).items()})


@lru_cache(maxsize=None)
def _to_chars(encoding: str) -> _Strict:
    return _Strict({b: c for b, c in _chars_of(encoding).items()})


def _as_bytes(text: str, encoding: str) -> str | None:
    """The bytes of `text` under an encoding, each as the character of its number; None if a character has none."""
    try:
        return text.translate(_to_bytes(encoding))
    except ValueError:
        return None


def undo_single(text: str, read_as: str, written_in: str) -> str | None:
    """`text`, read as one single-byte encoding, as it was written in another; None if a character has no byte or the byte none."""
    raw = _as_bytes(text, read_as)
    try:
        return None if raw is None else raw.translate(_to_chars(written_in))
    except ValueError:
        return None


@lru_cache(maxsize=None)
def _utf8_parts(encoding: str) -> tuple[frozenset[str], frozenset[str]]:
    """Characters that may stand for a first, and for a further byte of UTF-8 read as `encoding`."""
    either = lambda low, high: frozenset(v for c, b in _bytes_of(encoding).items() if low <= b <= high for v in (c, c.upper(), c.lower()))
    return either(0xC2, 0xF4), either(0x80, 0xBF) | {" "}


def _undo_multibyte(text: str) -> Iterator[tuple[str, str]]:
    """(restored, chain) of `text` written in an encoding of several bytes and read as one of single bytes."""
    for read_as in READ_AS:
        raw = _as_bytes(text, read_as)
        if raw is not None:
            for written_in in MULTIBYTE:
                try:
                    yield raw.encode("latin-1").decode(written_in), f"{read_as}>{written_in} "
                except UnicodeError:
                    pass


def _undo_utf8(text: str) -> list[tuple[str, str]]:
    """(restored, chain) of `text` written in UTF-8 and read otherwise, each shorter than `text`: those that leave no character beyond ASCII as it was, else all."""
    if len(text) < 2:
        return []
    seen, made = set(text), []
    for encoding in READ_AS:
        first, further = _utf8_parts(encoding)
        if not first.isdisjoint(seen) and not further.isdisjoint(seen) and (back := undo_utf8(text, encoding)) is not None:
            made.append((back, f"{encoding}>utf8 "))
    for encoding in MULTIBYTE:
        try:
            back = text.encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
        if len(back) < len(text):
            made.append((back, f"{encoding}>utf8 "))
    whole = [(back, chain) for back, chain in made if len(back.encode("utf-8", "replace")) <= len(text)]
    return whole or made


def _undo_singles(text: str) -> Iterator[tuple[str, str]]:
    """(restored, chain) of `text` written in one single-byte encoding, or one of several bytes, and read as another."""
    for read_as in READ_AS:
        raw = _as_bytes(text, read_as)
        if raw is not None:
            for written_in in WRITTEN_IN:
                if written_in != read_as:
                    try:
                        yield raw.translate(_to_chars(written_in)), f"{read_as}>{written_in} "
                    except ValueError:
                        pass
    yield from _undo_multibyte(text)


@lru_cache(maxsize=4096)
def restorations(text: str) -> tuple[tuple[str, str], ...]:
    """(restored text, chain) for every way in which `text` may have been misread, each restored text with its shortest chain.

    UTF-8 read otherwise is undone as often as it goes, as every such step shortens the text; before the first and after each
    of them, text of another encoding read otherwise is undone once, after it only where every byte is as it was (a space for a
    no-break space, or another case, is allowed for in UTF-8 alone).
    """
    found: dict[str, str] = {}
    edge, known = [(text, "", True)], {text}
    while edge:
        made = []
        for now, chain, exact in edge:
            for back, step in _undo_utf8(now):
                if back not in known:
                    known.add(back)
                    found[back] = chain + step
                    made.append((back, found[back], exact and _as_bytes(now, step.split(">")[0]) == back.encode("utf-8").decode("latin-1")))
            for back, step in _undo_singles(now) if exact else ():
                if back not in known:
                    found.setdefault(back, chain + step)
        edge = made
    return tuple(found.items())


@lru_cache(maxsize=4096)
def wide_restorations(text: str) -> tuple[tuple[str, str], ...]:
    """The same for a stretch whose ASCII characters may be second bytes."""
    found: dict[str, str] = {}
    for back, chain in _undo_multibyte(text):
        if len(back) < len(text):
            found.setdefault(back, chain)
    return tuple(found.items())


def undo_zeros(text: str) -> tuple[str, list[str]]:
    """`text` with its stretches of UTF-16 read byte by byte decoded, and their chains."""
    chains = []
    if "\x00" in text:
        for written_in, pattern in ZEROS.items():
            try:
                back = pattern.sub(lambda m: m.group().encode("latin-1").decode(written_in), text)  # noqa: B023
            except UnicodeError:
                continue
            if back != text:
                text, chains = back, [*chains, f"latin_1>{written_in}"]
    return text, chains


def _class(char: str) -> int:
    """Class of a character: by script and case for letters, by kind for all else."""
    kind = unicodedata.category(char)
    if char < "\x80":
        return 0 if char.islower() else 1 if char.isupper() else 2 if char.isdigit() else 3 if char.isspace() else 4
    if kind[0] == "L":
        script = 5 if char < "\u0250" else 7 if "\u0400" <= char < "\u0530" else 9
        return script + (kind == "Lu") if script < 9 else 9
    return {"Zs": 10, "Pi": 11, "Pf": 11, "Pd": 12, "Po": 13, "Sc": 14, "So": 15, "Sm": 15, "No": 15}.get(kind, 16)


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    return np.array([_class(chr(c)) for c in range(1 << 16)], dtype=np.int64)


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of the texts laid end to end; digits are 0, white space but the no-break space is a space, all beyond 16 bits are one."""
    joined = "  ".join(["", *texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    codes = np.where((codes >= 48) & (codes <= 57), 48, codes)
    codes = np.where((codes >= 9) & (codes <= 13), 32, codes)
    return np.minimum(codes, 0xFFFF)


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of each n-gram; of trigrams, and trigrams of classes, only those with a character beyond ASCII count."""
    if order == 1:
        return codes
    if order == 2:
        return ((codes[:-1] * 0x9E3779B1) ^ (codes[1:] * 0x85EBCA77)) % BUCKETS[2]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    keep = (a > 127) | (b > 127) | (c > 127)
    a, b, c = a[keep], b[keep], c[keep]
    if order == 0:
        table = _class_table()
        return (table[a] * CLASSES + table[b]) * CLASSES + table[c]
    return ((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (c * 0xC2B2AE3D)) % BUCKETS[3]


def count_ngrams(texts: list[str], sums: dict[int, np.ndarray]) -> None:
    """Adds the n-grams of the texts to the counts by order; trigrams beyond ASCII are few in a batch, so only these are sorted."""
    codes = _codes(texts)
    for n, size in BUCKETS.items():
        buckets = _buckets(codes, n)
        if n == 3:
            at, times = np.unique(buckets, return_counts=True)
            sums[n][at] += times
        else:
            sums[n] += np.bincount(buckets, minlength=size)


class NgramModel:
    """Joint probabilities of character trigrams, smoothed by what bigrams, and classes of characters, let expect."""

    def __init__(self, counts: dict[int, np.ndarray]) -> None:
        self.one, self.two, self.three, self.classes = (counts[n].astype(np.float32) for n in (1, 2, 3, 0))
        self.total = max(1.0, float(counts[1].sum()))
        of_class = np.bincount(_class_table(), weights=counts[1], minlength=CLASSES)
        #: Share of each character in its class. An unseen one is far rarer than any seen, so a restored text can't win by being short.
        self.share = ((counts[1] + 1e-6) / np.maximum(of_class[_class_table()], 1)).astype(np.float32)
        #: No trigram is likelier than any of its characters, so these bound the score of a text.
        self.most = np.where(np.arange(len(counts[1])) < 0x80, 0.0, np.log((counts[1] + 1e-3) / self.total)).astype(np.float32)
        self._start()

    def _start(self) -> None:
        self._trigrams: dict[str, float] = {}
        self._options: dict[tuple[str, bool], list[tuple[float, str, str, int]]] = {}
        self._best: dict[tuple[str, str, str, bool], tuple[str, str, float]] = {}
        self._bounds: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_trigrams", "_options", "_best", "_bounds")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _trigram(self, text: str) -> float:
        """Log probability of one trigram; in plain integers, as arrays of three cost more than the arithmetic."""
        if text.isascii():
            return 0.0
        a, b, c = (min(48 if 48 <= n <= 57 else 32 if 9 <= n <= 13 else n, 0xFFFF) for n in map(ord, text))
        pair = lambda x, y: float(self.two[((x * 0x9E3779B1) ^ (y * 0x85EBCA77)) % BUCKETS[2]])
        seen = float(self.three[((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (c * 0xC2B2AE3D)) % BUCKETS[3]])
        by_pairs = pair(a, b) * pair(b, c) / max(float(self.one[b]), 1.0)
        table = _class_table()
        by_class = float(self.classes[(int(table[a]) * CLASSES + int(table[b])) * CLASSES + int(table[c])]) + 1e-3
        for code in (a, b, c):
            by_class *= float(self.share[code])
        return math.log((0.8 * seen + 0.1 * by_pairs + 0.1 * by_class) / self.total)

    def score(self, text: str) -> float:
        """Sum of the log probabilities of the trigrams of `text` that have a character beyond ASCII."""
        known, total = self._trigrams, 0.0
        for at in range(len(text) - 2):
            trigram = text[at : at + 3]
            one = known.get(trigram)
            if one is None:
                if len(known) > 500_000:
                    known.clear()
                one = known[trigram] = self._trigram(trigram)
            total += one
        return total

    def bound(self, text: str) -> float:
        """What the score of `text`, among whatever neighbours, can't exceed."""
        known, total = self._bounds, 0.0
        for char in text:
            one = known.get(char)
            if one is None:
                one = known[char] = float(self.most[min(ord(char), 0xFFFF)])
            total += one
        return total

    def options(self, piece: str, wide: bool) -> list[tuple[float, str, str, int]]:
        """(bound, restored, chain, rank) of the restorations of `piece`, by rank and bound: 0 for readings of one kind, 1 for chains of UTF-8 and other encodings, 2 for all with characters that the clean records lack."""
        found = self._options.get((piece, wide))
        if found is None:
            make = wide_restorations if wide else restorations
            made = make(piece) if len(piece) <= LONG else make.__wrapped__(piece)
            unknown = lambda r: any(self.one[min(ord(c), 0xFFFF)] == 0 for c in r if c > "\x7f")
            mixed = lambda chain: len({step.endswith(">utf8") for step in chain.split()}) > 1
            found = sorted(((self.bound(r), r, chain, 2 if unknown(r) else int(mixed(chain))) for r, chain in made), key=lambda o: (o[3], -o[0]))
            if len(piece) <= LONG:
                if len(self._options) > 20_000:
                    self._options.clear()
                self._options[piece, wide] = found
        return found

    def best(self, before: str, piece: str, after: str, wide: bool = False) -> tuple[str, str, float]:
        """(restored, chain, gain) of the likeliest restoration of `piece` between its neighbours; an empty chain if none is likelier than `piece`.

        Characters that the clean records lack make a restoration unlikely, not impossible: it counts where none without them is
        likelier than `piece`, and one by a mixed chain where none by a plain one is. Those whose bound is too low to win needn't be scored.
        """
        key = (before, piece, after, wide)
        found = self._best.get(key)
        if found is None:
            options = self.options(piece, wide)
            own = self.score(before + piece + after) if options else 0.0
            top, found = own, (piece, "", -math.inf)
            tried = 0
            for bound, restored, chain, rank in options:
                if rank > tried and found[1]:
                    break
                tried = rank
                if bound <= top:
                    continue
                score = self.score(before + restored + after)
                if score > top:
                    top, found = score, (restored, chain, score - own)
            if len(piece) <= LONG:
                if len(self._best) > 300_000:
                    self._best.clear()
                self._best[key] = found
        return found


def best_restorations(text: str, model: NgramModel) -> Iterator[tuple[int, int, str, str, float]]:
    """(from, to, restored, chain, gain) of every stretch beyond ASCII that some chain makes likelier: the likeliest, by log probability over the text as it is.

    The two characters before a stretch are taken as restored, those after it as far as they are ASCII.
    """
    tail, at = "  ", 0
    while stretch := STRETCH.search(text, at):
        begin, end = stretch.span()
        whole = stretch.group()
        piece = whole.rstrip(" ")
        before = (tail + text[at:begin])[-2:]
        restored, chain, gain = model.best(before, piece, _after(text, begin + len(piece)))
        if len(whole) > len(piece) and (spaced := model.best(before, whole, _after(text, end)))[2] > gain:
            piece, (restored, chain, gain) = whole, spaced
        broad = WIDE.match(text, begin).group()
        if not chain and len(broad) > len(whole) and (read := model.best(before, broad, _after(text, begin + len(broad)), True))[2] > gain:
            piece, (restored, chain, gain) = broad, read
        at = begin + len(piece)
        if chain:
            yield begin, at, restored, chain, gain
        tail = (before + (restored if gain > 0 else piece))[-2:]


def _after(text: str, end: int) -> str:
    two = text[end : end + 2]
    return two if two.isascii() else two[:1] if two[:1].isascii() else ""


# ---- over a corpus

#: Gain, in natural log units, beyond which a record is kept out of training: low, as leaving out a clean record costs little.
DOUBTFUL = 5.0
#: The margin is never below this, as a small corpus shows too few clean names to validate it.
LEAST_MARGIN = 25.0
#: One of so many records is held out of training, to validate the margin.
HELD_OUT = 10
#: Misreadings that validation applies to clean text: the encodings it is written in and read as, in turn.
TRIALS = (("utf_8", "cp1252"), ("utf_8", "latin_1"), ("utf_8", "mac_roman"), ("utf_8", "cp437"), ("utf_8", "cp1250"), ("utf_8", "cp1251"), ("utf_8", "cp850"),
          ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"))
COUNTS = "kind tinyint, bucket int, n bigint"


def distinct_texts(read: DataFrame) -> DataFrame:
    """(h, t): every text beyond null once, with its hash, as many copies of a garbled text would teach a model that it is clean.

    Each partition keeps one copy before the shuffle, so a text with very many copies isn't sent to one task.
    """
    return read.where(F.col("t").isNotNull()).select(F.xxhash64("t").alias("h"), "t").dropDuplicates(["h"])


def _part(texts: DataFrame, held: bool) -> DataFrame:
    """Those of `distinct_texts` that are held out, or the others."""
    part = F.pmod("h", F.lit(HELD_OUT)) == 0
    return texts.where(part if held else ~part).select("t")


def _usable(text: str) -> bool:
    return LOST not in text and not CONTROL.search(text)


def _doubtful(text: str, model: NgramModel, above: float = DOUBTFUL) -> bool:
    return not text.isascii() and any(gain > above for *_, gain in best_restorations(text, model))


def train(texts: DataFrame, clean_by: NgramModel | None = None) -> NgramModel:
    """The model of the distinct texts (h, t) that are not held out, have no lost or control character, and aren't doubtful by an earlier model.

    Every partition counts n-grams of whole texts in arrays of fixed size, the sums by bucket are at most the model's size
    (2.4 million numbers) whatever the corpus, and so is what the driver gets and sends out.
    """
    earlier = texts.sparkSession.sparkContext.broadcast(clean_by) if clean_by else None

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros(size, dtype=np.int64) for n, size in BUCKETS.items()}
        for batch in batches:
            count_ngrams([t for t in batch.column("t").to_pylist() if _usable(t) and not (earlier and _doubtful(t, earlier.value))], sums)
        for n, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch({"kind": np.full(len(at), n, dtype=np.int8), "bucket": at.astype(np.int32), "n": counts[at]})

    total = _part(texts, False).mapInArrow(count, COUNTS).groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    kind, bucket, n = (total[c].combine_chunks().to_numpy() for c in ("kind", "bucket", "n"))
    counts = {order: np.zeros(size, dtype=np.int64) for order, size in BUCKETS.items()}
    for order in BUCKETS:
        counts[order][bucket[kind == order]] = n[kind == order]
    return NgramModel(counts)


def _trials(text: str, model: NgramModel) -> Iterator[tuple[int, float]]:
    """(0, gain) of each stretch of a clean text as it is, and (1, gain) of it misread by one of `TRIALS`."""
    for stretch in STRETCH.finditer(text):
        piece = stretch.group().rstrip(" ")
        begin = stretch.start()
        before, after = ("  " + text[max(0, begin - 2) : begin])[-2:], _after(text, begin + len(piece))
        gain = model.best(before, piece, after)[2]
        yield 0, gain
        written_in, read_as = TRIALS[zlib.crc32((before + piece + after).encode("utf-8", "replace")) % len(TRIALS)]
        try:
            misread = piece.encode(written_in).decode(read_as)
        except UnicodeError:
            continue
        if misread != piece:
            yield 1, model.best(before, misread, after)[2]


def validated_margin(texts: DataFrame, model: NgramModel) -> float:
    """The gain halfway between the greatest of clean stretches and the lowest percentile of misread ones, over all held-out texts.

    At least `LEAST_MARGIN`, also where there is nothing to validate on. Records that gain more than it are left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 300), dtype=np.int64)
        for batch in batches:
            for text in batch.column("t").to_pylist():
                if not text.isascii() and _usable(text) and not _doubtful(text, shared.value, LEAST_MARGIN):
                    for kind, gain in _trials(text, shared.value):
                        seen[kind, int(min(199, max(-100, gain))) + 100] += 1
        kind, bucket = np.nonzero(seen)
        yield pa.record_batch({"kind": kind.astype(np.int8), "bucket": bucket.astype(np.int32), "n": seen[kind, bucket]})

    rows = _part(texts, True).mapInArrow(measure, COUNTS).groupBy("kind", "bucket").agg(F.sum("n")).collect()
    clean = max((b - 100 for k, b, _ in rows if k == 0), default=0)
    misread = sorted((b - 100, n) for k, b, n in rows if k == 1)
    if not misread:
        return LEAST_MARGIN
    allowed = sum(n for _, n in misread) / 100
    low = next(b for i, (b, _) in enumerate(misread) if sum(n for _, n in misread[: i + 1]) > allowed)
    return max(LEAST_MARGIN, (max(clean, 0) + low) / 2)


def restore(text: str, model: NgramModel, margin: float) -> tuple[str, list[str], float]:
    """(text, chains, greatest gain): every stretch restored whose gain is beyond the margin, and those of the same chains that gain at all."""
    text, zeros = undo_zeros(text)
    found = list(best_restorations(text, model))
    chains = {chain for *_, chain, gain in found if gain > margin}
    if not chains:
        return text, zeros, max((gain for *_, gain in found), default=0.0)
    out, at = [], 0
    for begin, end, restored, chain, gain in found:
        if chain in chains and gain > 0:
            out += [text[at:begin], restored]
            at = end
    return "".join([*out, text[at:]]), zeros + sorted(c.strip() for c in chains), max(gain for *_, gain in found)


def garbled_records(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored_text, chains, gain, n_lost) of every document with a passage that was decoded under a wrong encoding.

    A passage is a stretch of characters beyond ASCII. It is garbled if reversing some chain of misreadings (UTF-8 or a
    encoding of one or several bytes read as another, any number of times, re-cased or with the no-break space made a space since) makes it
    likelier, with the two characters on either side, by more than a margin; `chains` has the chains, `restored_text` the
    text with all such passages restored. A U+FFFD stands for bytes that were lost, so a document with one (`n_lost` of
    them) is always garbled, and only its other passages can be restored; then, and if nothing was restored, `restored_text`
    still has what couldn't be. Null and empty texts, HTML entities and correct rare characters are no case: these occur in
    the clean records, too. Whole texts are read; repeated rows come out repeatedly; other columns may have any name; an
    empty table gives an empty result.

    The likelihood is that of a smoothed character trigram model of the clean texts: a first model of all texts finds
    doubtful ones, a second is trained without these. The margin is validated on held-out texts, as they are and misread
    on purpose. For these three passes every text counts once, however many copies it has: the distinct texts are written
    to the shared folder once. Then all rows are scored.
    """
    read = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    texts = materialize(distinct_texts(read), "texts")
    model = train(texts, clean_by=train(texts))
    margin = validated_margin(texts, model)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("restored_text", T.StringType()),
                        T.StructField("chains", T.StringType()), T.StructField("gain", T.DoubleType()), T.StructField("n_lost", T.LongType())])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if t.isascii() and "\x00" not in t:
                    continue
                restored, chains, gain = restore(t, shared.value, margin)
                lost = t.count(LOST)
                if chains or lost:
                    rows.append((d, restored, ", ".join(chains), gain, lost))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((batch.schema.field("d").type, pa.string(), pa.string(), pa.float64(), pa.int64()))], names=out.names)

    return read.where(F.col("t").isNotNull()).mapInArrow(find, out)
