"""Identifiers derived from content, without UDFs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: namespace of evidence identifiers.
NAMESPACE = uuid.UUID("0df0b2a5-e0ba-426a-ab31-4ea724f356ce")


def article_id(day: Column, session: Column, text: Column) -> Column:
    """SHA-1 of day, session and text joined by a pipe."""
    return F.sha1(F.concat_ws("|", F.date_format(day, "yyyy-MM-dd"), session, text))


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab" * 4]), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def evidence_id(ticker: Column, cik: Column, filed_at: Column, accession: Column, form: Column) -> Column:
    """UUID of the SHA-256 of the evidence's JSON with sorted keys; missing members stay out."""
    record = F.struct(accession.alias("accession_num"), cik.alias("candidate_cik"), F.date_format(filed_at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("filed_at"), form.alias("form_type"), ticker.alias("ticker"))
    return uuid5(F.sha2(F.to_json(record), 256))
