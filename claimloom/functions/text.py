"""Column expressions on text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as white space around and between words.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as a class for regular expressions, in Spark and in other engines.
WHITE_CLASS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: General terms that don't ground an entity by themselves.
STOP_WORDS = (
    "ai", "기반", "분야", "관련", "사업", "기술", "플랫폼", "인프라",
    "솔루션", "시스템", "시장", "센터", "그룹", "전략", "협력", "산업", "혁신",
)

#: Display names of classification codes.
CLASSIFICATION_NAMES = {
    "COMPANY": "기업",
    "FACILITY": "생산 시설",
    "PROGRAM": "지원 사업",
    "ORGANIZATION": "주관 기관",
    "AGENCY": "지원 기관",
    "TECH": "기술",
    "PROJECT": "프로젝트",
    "TOPIC": "주제",
    "PERSON": "인물",
    "GENERAL": "일반",
}

#: Display names of relation codes.
RELATION_NAMES = {
    "OPERATES": "운영",
    "SUPPLY_CONTRACT_WITH": "공급 계약",
    "ORGANIZES": "주관",
    "PARTNERS_WITH": "협력",
    "DEVELOPS": "개발",
    "MANUFACTURES": "제조",
    "CO_DEVELOPS": "공동 개발",
    "USES": "활용",
    "SUPPORTS": "지원",
    "BENEFITS_FROM": "수혜",
    "PARTICIPATES_IN": "참여",
}


def strip(text: Column) -> Column:
    """text without white space of any kind around it; null stays null."""
    return F.btrim(text, F.lit(WHITE))


def blank(text: Column) -> Column:
    """Whether text is null, empty or white space only."""
    return F.coalesce(strip(text), F.lit("")) == ""


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts and styles go without a trace, tags become a blank, white space shrinks to one blank. Entities stay; null gives null."""
    bare = F.regexp_replace(html, r"(?is)<script.*?>.*?</script>|<style.*?>.*?</style>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), WHITE_CLASS + "+", " "))


def page_title(html: Column, url: Column) -> Column:
    """What the first <title> on one line holds, stripped, even if empty; the url where there is none."""
    found = strip(F.regexp_extract(html, r"(?i)<title>(.*?)</title>", 1))
    return F.when(html.rlike(r"(?i)<title>(.*?)</title>"), found).otherwise(url)


def text_title(content: Column, filename: Column) -> Column:
    """The file's name, or the first 30 characters on one line."""
    return F.coalesce(filename, F.translate(F.substring(content, 1, 30), "\n", " "))


def normalize_lines(text: Column) -> Column:
    """Line ends as \\n, no blanks at line ends, at most one empty line in a row, no blanks around. Without NFC."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?dmU)[\s&&[^\n]]+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normalisation form C, for which there is no SQL function."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalize_text(text: Column) -> Column:
    """normalize_lines of the NFC form. Text of ASCII characters is in that form, and isn't sent to Python."""
    other = F.when(F.octet_length(text) != F.length(text), text)
    return normalize_lines(F.coalesce(nfc(other), text))


def casefold(text: Column) -> Column:
    """Lower case, with ß as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def alias_present(text: Column, aliases: list[str]) -> Column:
    folded = casefold(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for a in aliases:
        hit = hit | folded.contains(a.casefold())
    return hit


def alias_tags(text: Column, groups: dict[str, list[str]]) -> Column:
    """Names of the groups of which an alias occurs, in the groups' order."""
    return F.filter(F.array(*[F.when(alias_present(text, a), F.lit(g)) for g, a in groups.items()]), lambda x: x.isNotNull())


def paragraphs(body: Column) -> Column:
    """Non-blank paragraphs: lines, blank lines between them or not."""
    return F.filter(F.split(body, r"\n\s*\n|\n"), lambda p: strip(p) != "")


def relevance(title: Column, body: Column, aliases: list[str], lead: bool = True) -> Column:
    """DIRECT if an alias is in the title (or, with lead, the first two paragraphs), BACKGROUND if in the body, else IRRELEVANT."""
    start = F.array_join(F.slice(paragraphs(body), 1, 2), "\n")
    direct = alias_present(title, aliases) | (alias_present(start, aliases) if lead else F.lit(False))
    return F.when(direct, "DIRECT").when(alias_present(body, aliases), "BACKGROUND").otherwise("IRRELEVANT")


def partners_named(title: Column, body: Column, subject: list[str], partners: dict[str, list[str]]) -> Column:
    """Names of the partners, in their order, that some context, title or paragraph, names together with the subject."""
    contexts = F.concat(F.array(F.coalesce(title, F.lit(""))), paragraphs(F.coalesce(body, F.lit(""))))
    with_subject = F.filter(contexts, lambda p: alias_present(p, subject))
    named = lambda aliases: F.exists(with_subject, lambda p: alias_present(p, aliases))
    hits = [F.when(named(a), F.lit(name)) for name, a in partners.items()]
    return F.array_compact(F.array(*hits))


def cooccurrences(title: Column, body: Column, subject: list[str], partner: list[str]) -> Column:
    """Number of contexts, title or paragraph, that name both."""
    contexts = F.concat(F.array(F.coalesce(title, F.lit(""))), paragraphs(F.coalesce(body, F.lit(""))))
    return F.size(F.filter(contexts, lambda p: alias_present(p, subject) & alias_present(p, partner)))


def script_counts(text: Column, script: str) -> tuple[Column, Column, Column]:
    """(characters of a regex class, letters, their ratio rounded to 6; 0 without letters)."""
    own, letters = F.regexp_count(text, F.lit(script)), F.regexp_count(text, F.lit(r"\p{L}"))
    return own, letters, F.round(F.coalesce(F.try_divide(own, letters), F.lit(0.0)), 6)


#: A date and a time with a zone: with separators or compact, any character between date and time.
_INSTANT = r"(?s)^(\d{4})(-?)(\d{2})\2(\d{2}).(\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(?:([+-]\d{2})(?::?(\d{2})(?::?\d{2})?)?|Z)$"


def published_at(raw: Column) -> tuple[Column, Column]:
    """(UTC timestamp, precision) of a text without white space around it: a date with dashes gives DAY, an ISO 8601 date (not a week date) and time with a zone INSTANT, anything else null. Seconds of a zone are left out."""
    raw = strip(raw)
    day = raw.rlike(r"^\d{4}-\d{2}-\d{2}$")
    part = lambda k, none: F.coalesce(F.nullif(F.regexp_extract(raw, _INSTANT, k), F.lit("")), F.lit(none))
    iso = F.concat(part(1, ""), F.lit("-"), part(3, ""), F.lit("-"), part(4, ""), F.lit("T"), part(5, ""), F.lit(":"), part(7, "00"), F.lit(":"), part(8, "00"), F.lit("."), part(9, "0"), part(10, "+00"), F.lit(":"), part(11, "00"))
    value = F.when(day, F.try_to_timestamp(raw)).when(raw.rlike(_INSTANT), F.try_to_timestamp(iso))
    return value, F.when(value.isNotNull() & day, "DAY").when(value.isNotNull(), "INSTANT")


def flag(raw: Column) -> Column:
    return F.lower(strip(raw)).isin("1", "true", "yes", "y")


def strip_fence(raw: Column) -> Column:
    """JSON without a Markdown code fence around it."""
    return strip(F.regexp_replace(strip(raw), r"(?s)^```(?:json)?\s*|\s*```$", ""))


def json_object(raw: Column, schema: str) -> Column:
    """A JSON object, in a Markdown fence or not, decoded by a schema; null where it is no object."""
    text = strip_fence(raw)
    return F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def quote_offsets(quote: Column, content: Column) -> tuple[Column, Column]:
    """Half-open place of the quote's first occurrence, in code points; null where there is none."""
    at = F.position(quote, content)
    start = F.when(at > 0, at - 1)
    return start, start + F.length(quote)


def capitalized(code: Column) -> Column:
    return F.concat(F.upper(F.substring(code, 1, 1)), F.lower(F.substr(code, F.lit(2))))


def normalized_code(code: Column, default: str) -> Column:
    c = F.upper(strip(F.coalesce(code, F.lit(""))))
    return F.when(c == "", F.lit(default)).otherwise(c)


def growth_percent(current: Column, previous: Column) -> Column:
    """(current - previous) / previous * 100; null where previous is null or 0."""
    return F.try_divide((current - previous).cast("double"), previous.cast("double")) * 100
