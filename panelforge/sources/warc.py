"""Web archive files: records, payloads as text, and the gates that an article passes."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "path string, uri string, warc_date string, status int, content_type string, payload binary, error string"
# Names of encodings that decoders don't know.
ENCODING_ALIASES = {"cp-1251": "cp1251", "windows-1251": "cp1251", "en_us.utf-8": "utf-8", "en-us.utf-8": "utf-8", "utf8": "utf-8"}
LEAST_WORDS, MOST_WORDS, MOST_FIRMS, ENGLISH = 25, 3000, 3, 0.99


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k.strip()}


def _head(stream: io.BufferedIOBase) -> list[bytes]:
    out = []
    while (line := stream.readline()) not in (b"", b"\r\n", b"\n"):
        out.append(line)
    return out


def records(stream: io.BufferedIOBase, path: str) -> Iterator[tuple]:
    """The response records of an archive; one that can't be read comes out with its error, and the file goes on behind it."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = _headers(_head(stream))
        body = stream.read(int(head.get("content-length", "0")))
        if head.get("warc-type") != "response":
            continue
        uri, date = head.get("warc-target-uri"), head.get("warc-date")
        try:
            http = io.BytesIO(body)
            status = int(http.readline().split()[1])
            fields = _headers(_head(http))
            payload, packing = http.read(), fields.get("content-encoding", "").lower()
            if packing in ("gzip", "x-gzip"):
                payload = gzip.decompress(payload)
            elif packing == "deflate":
                payload = zlib.decompress(payload)
            yield path, uri, date, status, fields.get("content-type"), payload, None
        except (ValueError, IndexError, OSError, EOFError, zlib.error) as error:
            yield path, uri, date, None, None, None, f"{type(error).__name__}: {error}"


def read_archives(spark: SparkSession, paths: DataFrame, path: str = "path", batch: int = 64) -> DataFrame:
    """Records of the gzipped archives whose paths the rows name; a task streams one file after another and holds `batch` records."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        names = [c.split()[0] for c in RECORD.split(", ")]
        for frame in frames:
            for name in frame[path]:
                held = []
                try:
                    fs, inner = pafs.FileSystem.from_uri(name if "://" in name else f"file://{name}")
                    with fs.open_input_stream(inner, compression=None) as raw, gzip.open(raw) as stream:
                        for record in records(stream, name):
                            held.append(record)
                            if len(held) == batch:
                                yield pd.DataFrame(held, columns=names)
                                held = []
                except (OSError, EOFError, ValueError) as error:
                    held.append((name, None, None, None, None, None, f"{type(error).__name__}: {error}"))
                if held:
                    yield pd.DataFrame(held, columns=names).astype({"status": "Int32"})

    return paths.select(path).mapInPandas(run, RECORD)


def charset(content_type: Column) -> Column:
    """Declared encoding, lower case, by a name that decoders know; UTF-8 if none is."""
    name = F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", 1))
    out = F.when(name == "", F.lit("utf-8")).otherwise(name)
    for alias, known in ENCODING_ALIASES.items():
        out = F.when(name == alias, known).otherwise(out)
    return out


def decoded(payload: Column, encoding: Column) -> Column:
    """Payload as text under its encoding, else UTF-8, else Latin-1."""

    @F.pandas_udf("string")
    def run(data: pd.Series, names: pd.Series) -> pd.Series:
        def one(raw: bytes | None, name: str | None) -> str | None:
            if raw is None:
                return None
            for candidate in (name or "utf-8", "utf-8"):
                try:
                    return bytes(raw).decode(candidate)
                except (UnicodeDecodeError, LookupError):
                    continue
            return bytes(raw).decode("latin-1")

        return pd.Series([one(d, n) for d, n in zip(data, names, strict=True)], dtype=object)

    return run(payload, encoding)


def gate(status: Column, content_type: Column, text: Column, english: Column, firms: Column) -> Column:
    """The first test that a record fails, or `kept`; in the order in which they are cheap."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return (
        F.when(~F.coalesce(status == 200, F.lit(False)), "status").when(~F.coalesce(F.lower(content_type).contains("html"), F.lit(False)), "content_type")
        .when(F.coalesce(text, F.lit("")) == "", "no_text").when(words < LEAST_WORDS, "too_short").when(words > MOST_WORDS, "too_long")
        .when(~F.coalesce(english >= ENGLISH, F.lit(False)), "language").when(F.coalesce(F.size(firms), F.lit(0)) < 1, "no_firm").when(F.size(firms) > MOST_FIRMS, "many_firms").otherwise("kept")
    )


def gate_counts(gated: DataFrame, keys: list[str], column: str = "gate") -> DataFrame:
    """Records that reached each stage of the gates by key; a later stage never counts more than an earlier."""
    order = ("status", "content_type", "no_text", "too_short", "too_long", "language", "no_firm", "many_firms", "kept")
    at = F.array_position(F.array(*[F.lit(g) for g in order]), F.col(column))
    return gated.groupBy(*keys).agg(F.count("*").alias("records"), *[F.count(F.when(at > i + 1, 1)).alias(f"passed_{g}") for i, g in enumerate(order[:-1])])
