"""Text expressions: the two tokenizers, headings, URLs, ids, categories and judge scores."""

from __future__ import annotations

import unicodedata
import uuid
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import STOPWORDS

#: Latin letters with one mark, their plain letters, and those marks, by Unicode decomposition; letters with several marks stay.
_MARKED = [(c, *d) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c).replace("\u017f", "s")) == 2 and c.islower() and d[0].isascii()]
ACCENTED, PLAIN = ("".join(x) + y for x, y in zip(list(zip(*_MARKED, strict=True))[:2], "\u017fs", strict=True))
COMBINING = "".join(sorted({m for *_, m in _MARKED}))
QUERY_TOKEN = r"(?U)\w+"
INDEX_TOKEN = r"[\p{L}\p{N}\p{Co}]+"
LEXICAL = r"(?U)\w+_\w+|\w+(?:\.\w+){2,}"
#: Fixed value: the namespace of chunk ids.
NAMESPACE = uuid.UUID("1b9d6bcd-bbfd-4b2d-9b5d-ab8dfbbd4bed")


def query_tokens(text: Column) -> Column:
    """All word tokens of a query, lower-cased, underscores kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(QUERY_TOKEN), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Query tokens without stopwords and single characters, repeats kept; all tokens if nothing else is left."""
    every = query_tokens(text)
    content = F.filter(every, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))
    return F.when(F.size(content) > 0, content).otherwise(every)


def index_tokens(text: Column) -> Column:
    """Terms of the index side: letters and digits only, case and diacritics folded. Marks that stand apart (COMBINING) belong to their letter."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED + COMBINING, PLAIN)
    return F.regexp_extract_all(folded, F.lit(INDEX_TOKEN), F.lit(0))


def is_lexical(text: Column) -> Column:
    """Whether a query holds an identifier: snake case, or three dotted parts."""
    return text.rlike(LEXICAL)


def squash(text: Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without the whitespace at both ends, of whatever kind."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def snippet(text: Column, size: int = 200) -> Column:
    return F.substring(squash(text), 1, size)


def clean_heading(heading: Column) -> Column:
    """Without leading section numbers; the original if nothing else is left."""
    rest = strip(F.regexp_replace(heading, r"^\d+(\.\d+)*\s+", ""))
    return F.when(F.length(rest) > 0, rest).otherwise(heading)


@F.pandas_udf(T.StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Every letter run capitalised, digits ending a run (differs from initcap)."""
    return s.str.title()


def title_fallback(doc_id: Column) -> Column:
    return title_case(F.translate(doc_id, "-_", "  "))


def with_path(path: Column, text: Column, include: bool = True) -> Column:
    """Section path and text as a reranker reads them."""
    if not include:
        return text
    return strip(F.concat(F.array_join(F.coalesce(path, F.array().cast("array<string>")), " > "), F.lit("\n"), text))


def urldefrag(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def in_scope(url: Column, host_prefix: Column | str, path_prefix: Column | str) -> Column:
    """Whether a crawl may follow a URL: both prefixes, and an .htm or .html path; the fragment doesn't count."""
    bare, lit = urldefrag(url), lambda x: F.lit(x) if isinstance(x, str) else x
    return bare.startswith(lit(host_prefix)) & bare.startswith(lit(path_prefix)) & F.lower(F.regexp_replace(bare, r"\?.*$", "")).rlike(r"\.html?$")


def slug_for_url(url: Column, marker: str = "/Content/") -> Column:
    """File name of a page: its path after the marker, without .htm(l), other characters to underscores; index.html if empty."""
    path = F.regexp_replace(F.regexp_replace(urldefrag(url), r"^[a-zA-Z]+://[^/]*", ""), r"\?.*$", "")
    tail = F.when(F.instr(path, marker) > 0, F.substr(path, F.instr(path, marker) + len(marker))).otherwise(path)
    slug = F.regexp_replace(F.regexp_replace(tail, r"\.html?$", ""), r"[^A-Za-z0-9]+", "_")
    slug = F.regexp_replace(slug, r"^_+|_+$", "")
    return F.concat(F.when(F.length(slug) > 0, slug).otherwise("index"), F.lit(".html"))


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """Absolute URLs by the rules of RFC 3986."""
    return pd.Series([urljoin(b or "", x or "") for b, x in zip(base, link, strict=True)])


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Version-5 UUID of a name: the leading half of SHA-1 over namespace and name, with version and variant set."""
    ns = F.unhex(F.lit(namespace.hex))
    h = F.sha1(F.concat(ns, name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def chunk_id(doc_id: Column, chunk_index: Column) -> Column:
    return uuid5(F.concat_ws(":", doc_id, chunk_index.cast("string")))


def category(qid: Column, tag: Column, products: Column) -> Column:
    """exact_term by tag, adversarial by id prefix, cross by several products, else single."""
    return F.when(F.coalesce(tag, F.lit("")) != "", tag).when(qid.startswith("adv-"), "adversarial").when(F.size(products) > 1, "cross").otherwise("single")


def mentions(haystack: Column, keywords: Column) -> Column:
    """Whether any keyword stands in the text, whatever the case."""
    return F.exists(keywords, lambda k: F.contains(F.lower(haystack), F.lower(k)))


def score(value: Column, top: int = 5) -> Column:
    """A judge's number: its whole part within 0..top; 0 if it is none."""
    return F.greatest(F.lit(0), F.least(F.lit(top), F.coalesce(value.try_cast("double").try_cast("int"), F.lit(0))))


def grade(value: Column, top: int = 3) -> Column:
    """A relevance grade: a whole number within 0..top; 0 if it is none (2.7 as text is none)."""
    return F.greatest(F.lit(0), F.least(F.lit(top), F.coalesce(value.try_cast("int"), F.lit(0))))


def loose_json(text: Column) -> Column:
    """The text if it is a JSON object, else its part from the first to the last brace."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), text).otherwise(body)
