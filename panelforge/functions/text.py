"""Names, tickers, words and tokens as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.stemmer import stem, stemmed

# Words dropped from company names, in this order.
NAME_SUFFIXES = (
    "INC", "INCDE", "INCMD", "INCORPORATED", "CORP", "CORPORATION", "INTERNATIONAL", "GROUP", "CO", "COMPANY", "LLC", "LP", "L.P.", "LLLP", "LLP", "LTD", "LIMITED",
    "HOLDINGS", "HLDGS", "HOLDING", "PLC", "DE", "MD", "UT", "MO",
)
# How a boilerplate article begins, and what it contains.
NOISY_PREFIXES = (
    "LAST PRICE", "PRICE CHANGE", "CURRENCY IN", "MARKET DATA IS DELAYED", "YOU HAVE RUN OUT OF FREE ARTICLES", "SUBSCRIBE TO CONTINUE READING", "PLEASE SUBSCRIBE TO KEEP READING",
    "LOGIN TO CONTINUE", "SUBSCRIPTION REQUIRED", "REGISTER TO READ MORE", "VIEW ALL POPULAR POSTS", "RECEIVE NEWS & RATINGS VIA EMAIL", "SIGN UP FOR OUR NEWSLETTER", "ENTER YOUR EMAIL",
    "PLEASE NOTE:", "DISCLAIMER:", "THE INFORMATION PROVIDED", "THIS CONTENT IS PROVIDED FOR INFORMATIONAL PURPOSES ONLY", "FINANCIALBUZZ.COM IS NOT A", "THIS IS NOT A RECOMMENDATION",
    "RETURN TO HOMEPAGE", "HOMEPAGE", "GO BACK TO HOME PAGE", "PLEASE VERIFY YOU ARE A HUMAN", "ACCESS DENIED", "REQUEST BLOCKED", "YOUR BROWSER DOES NOT SUPPORT COOKIES",
    "404 NOT FOUND", "PAGE NOT FOUND", "ERROR 404", "THE PAGE YOU ARE LOOKING FOR", "% % %",
)
NOISY_SUBSTRINGS = (
    "ADVERTISEMENT", "ADVERTISEMENT STORY CONTINUES BELOW", "SPONSORED CONTENT", "READ MORE:", "RELATED ARTICLES:", "SUBSCRIBE NOW", "UNLOCK MORE ARTICLES", "THE MOTLEY FOOL RECOMMENDS",
    "THE MOTLEY FOOL HAS A DISCLOSURE POLICY", "THIS STORY WAS GENERATED BY AUTOMATED INSIGHTS", "THIS ARTICLE WAS ORIGINALLY PUBLISHED ON", "DISTRIBUTED BY PUBLIC, UNEDITED",
    "PRESS RELEASE DISTRIBUTED BY", "COPYRIGHT", "ALL RIGHTS RESERVED", "SHARE THIS ARTICLE", "FOLLOW US ON", "CONNECT WITH US",
)
ENGLISH_CONFIDENCE = 0.999996
# English function words.
STOP_WORDS = tuple((
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't "
    "weren weren't won won't wouldn wouldn't").split())
#: Labels of plain, million and billion numbers, for topic models and for coherence.
NUMBER_LABELS = ("__NUM__", "__MIL__", "__BIL__")
COHERENCE_LABELS = ("num", "mil", "bil")


def canonical_ticker(c: Column) -> Column:
    """Upper case, without white space, `.` and `/` as `-`."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"\s+", ""), r"[./]", "-")


def canonical_company(c: Column, suffixes: tuple[str, ...] = NAME_SUFFIXES, literal: bool = False) -> Column:
    """Upper case without `,&-/.`, legal forms and spaces. A suffix is a pattern, so `L.P.` takes any letter for its dots, unless `literal`."""
    out = F.regexp_replace(F.upper(F.trim(c)), r"[,&\-/.]", "")
    for suffix in suffixes:
        out = F.regexp_replace(out, rf"\b{re.escape(suffix) if literal else suffix}\b\.?", "")
    return F.regexp_replace(out, r"\s+", "")


def canonical_word(c: Column) -> Column:
    """Letters and digits only, upper case."""
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def digits_only(c: Column, length: int = 10) -> Column:
    """The digits of a cell if there are exactly `length`, else null."""
    out = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(out) == length, out)


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def is_clean_article(text: Column, confidence: Column, threshold: float = ENGLISH_CONFIDENCE) -> Column:
    """Neither begins nor continues like boilerplate and is English with at least the threshold's confidence. Null counts as not clean."""
    noisy = text.rlike(f"^(?:{_any_of(NOISY_PREFIXES)})") | text.rlike(_any_of(NOISY_SUBSTRINGS))
    return F.coalesce(~noisy & (confidence >= threshold), F.lit(False))


def tokens(df: DataFrame, id_column: str, text: Column) -> DataFrame:
    """(id, pos, token): runs of A-Z and 0-9 of the upper-cased text, in order; a text without any has no row."""
    words = F.filter(F.split(F.regexp_replace(F.upper(text), r"[^A-Z0-9\s]", " "), r"\s+"), lambda w: w != "")
    return df.select(F.col(id_column), F.posexplode(words).alias("pos", "token"))


def token_type(token: Column) -> Column:
    return F.when(token.rlike("^[A-Z]+$"), "alpha").when(token.rlike("^[0-9]+$"), "numeric").otherwise("alphanumeric")


def canonical_number(token: Column, labels: tuple[str, str, str] = NUMBER_LABELS) -> Column:
    """Label of a number by magnitude."""
    value = token.try_cast("double")
    return F.when(value >= 1e9, labels[2]).when(value >= 1e6, labels[1]).when(value.isNotNull(), labels[0])


def canonical_tokens(df: DataFrame, id_column: str, text: Column, labels: tuple[str, str, str] = NUMBER_LABELS, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(id, pos, token): stems without stop words and one-letter words; numbers as labels; digits dropped from mixed tokens.

    No shuffle: stemming happens where the rows are.
    """
    kind = token_type(F.col("token"))
    bare = F.when(kind == "numeric", canonical_number(F.col("token"), labels)).when(kind == "alphanumeric", F.regexp_replace("token", "[0-9]", "")).otherwise(F.col("token"))
    typed = tokens(df, id_column, text).select(id_column, "pos", (kind == "numeric").alias("_number"), bare.alias("token"))
    out = typed.select(id_column, "pos", "_number", F.when(F.col("_number"), F.col("token")).otherwise(stemmed(F.col("token"))).alias("token"))
    stops = [stem(w) for w in stop_words]
    return out.where(F.col("_number") | (~F.col("token").isin(stops) & (F.length("token") > 1) & ~F.col("token").rlike(r"\d"))).select(id_column, "pos", "token")
