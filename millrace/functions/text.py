"""Text functions as column expressions, and HTML ones as Arrow batches of a small parser."""

from __future__ import annotations

import unicodedata
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Persian and Arabic digits, and what they stand for.
FOREIGN_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "01234567890123456789"


def ascii_digits(c: Column) -> Column:
    return F.translate(c, FOREIGN_DIGITS, ASCII_DIGITS)


def phone_key(c: Column) -> Column:
    """The last ten digits."""
    return F.right(F.regexp_replace(ascii_digits(c), "[^0-9]", ""), F.lit(10))


def without_date_windows(c: Column) -> Column:
    """Without bracketed parts, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "\\[[^\\]]*\\]", " "), "\\s+", " "))


def code_form(c: Column) -> Column:
    """Trouble codes in one form: upper case, digits in ASCII, a colon as hyphen, a split letter joined, seven characters as 5-2."""
    joined = F.regexp_replace(F.replace(F.upper(ascii_digits(c)), F.lit(":"), F.lit("-")), "\\b([A-Z])\\s+([0-9A-F]{4})\\b", "$1$2")
    return F.regexp_replace(joined, "\\b([A-Z][0-9A-F]{4})([0-9A-F]{2})\\b", "$1-$2")


def segment_url(c: Column) -> Column:
    """A path segment, fully percent-encoded, its slash as U+2044."""
    return F.replace(F.url_encode(F.replace(c, F.lit("/"), F.lit("⁄"))), F.lit("+"), F.lit("%20"))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("<a href=\"([^\"]*)\""), 1)


def numbers(c: Column, above: float = 20) -> Column:
    """Numbers in a text (digits in ASCII, decimal comma as point), small whole ones left out."""
    found = F.regexp_extract_all(F.regexp_replace(ascii_digits(c), "([0-9]),([0-9])", "$1.$2"), F.lit("([0-9]+(?:\\.[0-9]+)?)"), 1)
    return F.filter(found, lambda x: x.contains(".") | (x.cast("double") > above))


def scrubbed(c: Column) -> Column:
    """Passwords, tokens and keys given as `name=value` replaced."""
    return F.regexp_replace(c, "(?i)\\b(password|token|secret|api_key)=\\S+", "$1=[removed]")


def endpoint_group(path: Column, prefixes: dict[str, str]) -> Column:
    """The group of the first matching prefix, else the first two segments."""
    out = None
    for p, g in prefixes.items():
        out = (F.when(path.startswith(p), g) if out is None else out.when(path.startswith(p), g))
    rest = F.array_join(F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, 2), "/")
    return rest if out is None else out.otherwise(rest)


def follows_up(c: Column) -> Column:
    """Whether a question leans on the one before: short, or it begins with a reference."""
    return (F.size(F.split(F.trim(c), "\\s+")) <= 4) | F.lower(c).rlike("^(and|what about|it|that|this|those|these)\\b")


_BLOCKS = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "br", "section", "article", "table", "ul", "ol", "nav"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in _BLOCKS:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def flat_text(html: str | None) -> str | None:
    """Visible text: scripts and styles dropped, cells parted by bars, blanks collapsed, at most two line feeds in a row."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    lines = [" ".join(x.split()).strip(" |") for x in "".join(p.out).split("\n")]
    return "\n".join(x for i, x in enumerate(lines) if x or (i and lines[i - 1])).strip()


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(flat_text)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


class _Clean(HTMLParser):
    ALLOWED = {"p", "b", "i", "ul", "ol", "li", "br", "h1", "h2", "h3", "article", "a"}

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "iframe", "object"):
            self.hidden += 1
        elif not self.hidden and tag in self.ALLOWED:
            href = next((v for k, v in attrs if tag == "a" and k == "href" and v), None)
            plain = "".join(ch for ch in href or "" if ch > " ").lower()
            safe = href is not None and (":" not in plain.split("/")[0] or plain.startswith(("http:", "https:", "mailto:")))
            self.out.append(f'<{tag} href="{escape(href)}">' if safe else f"<{tag}>")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "iframe", "object"):
            self.hidden = max(0, self.hidden - 1)
        elif not self.hidden and tag in self.ALLOWED:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


@F.pandas_udf(StringType())
def sanitized_html(html: pd.Series) -> pd.Series:
    """Allowed tags and safe links only; script-like elements go with their content, other tags are unwrapped."""

    def clean(x: str | None) -> str | None:
        if x is None:
            return None
        p = _Clean()
        p.feed(x)
        p.close()
        return "".join(p.out)

    return html.map(clean)
