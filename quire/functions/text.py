"""Column functions on text: built in and evaluated in the JVM, but for the scan of JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .executors import ship

# Topics and the keywords that mark them, matched as substrings of the lower-cased text.
TOPICS = {
    "Python": ["python", "django", "flask", "fastapi", "pytest", "pip"],
    "Data Science": ["data", "analytics", "pandas", "numpy", "visualization", "matplotlib"],
    "Machine Learning": ["ml", "machine learning", "deep learning", "neural", "ai", "llm", "tensorflow", "pytorch"],
    "Architecture": ["architecture", "design patterns", "clean code", "solid", "refactoring"],
    "DevOps": ["docker", "kubernetes", "k8s", "devops", "ci/cd", "cloud", "container"],
    "Linux": ["linux", "ubuntu", "systemd", "kernel", "bash", "shell"],
    "Networking": ["networking", "network", "firewall", "vpn", "tcp", "ip", "http"],
    "Web Development": ["web", "api", "rest", "frontend", "backend", "node", "javascript"],
    "Databases": ["database", "sql", "nosql", "postgresql", "mongodb", "redis"],
    "Security": ["security", "encryption", "authentication", "oauth", "ssl", "tls"],
    "Quantum": ["quantum", "qubit"],
    "Forecasting": ["forecasting", "time series", "prediction", "arima"],
    "Async/Concurrency": ["async", "await", "concurrent", "parallel", "threading", "multiprocessing"],
}
# Title patterns.
SUSPICIOUS_TITLES = (r"(?i)\.(zip|exe|rar|msi|dmg|pkg|tar|gz|7z)\b", r"(?i)^Table\s+\d+", r"^\d+$", r"[/\\][A-Za-z]:[/\\]", r"^[/\\](?:usr|tmp|var|etc|home)[/\\]")
GENERIC_TITLE = r"(?i)^section\s+\d+$|^part\s+\d+$|^chapter\s+\d+$|^\(title missing\)$|^untitled$|^\d+$|^ch\.?\s*\d+$"
ARTIFACT_TITLE = r"(?i)page\s+\d+|\bpp?\.\s*\d+|<[^>]+>|\x0c|_{3,}"
NON_CHAPTER_TITLE = (
    r"(?i)^preface$|^foreword$|^introduction$|^appendix|^glossary$|^index$|^bibliography$|^references$|^acknowledg|^about the author|^copyright|^dedication$|^colophon$"
    r"|^epilogue$|^prologue$|^table of contents$|^title page$|^half title|^also by|^praise for|^other books|^further reading$|^notes$"
)

# Unicode's spaces, which SQL's trim takes off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def words(text: Column) -> Column:
    """Words between runs of Unicode white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether one of the literal keywords stands in the text; one pass of one expression."""
    return text.rlike("|".join(re.escape(k) for k in keywords))


def once(value: Column, use) -> Column:
    """use(value), with the value computed once for each row however often it stands in the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pinned(value: Column) -> Column:
    """value, in a column that Catalyst doesn't copy into the expressions above: lambdas read it without computing it anew
    for each element."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def first_of_each(items: Column, key: str) -> Column:
    """Of an array of structs, of which `key` is the first field and the place the second: the first of each key, by key.
    items must be a pinned column that is sorted."""
    return F.filter(items, lambda x, i: (i == 0) | (x[key] != F.get(items, i - 1)[key]))


def topics(text: Column) -> Column:
    """The topics of the text in declared order; General if there is none. Keywords are searched as plain substrings."""

    def found(lower: Column) -> Column:
        holds = lambda keywords: reduce(Column.__or__, (F.contains(lower, F.lit(k)) for k in keywords))
        return F.array_compact(F.array(*(F.when(holds(k), F.lit(t)) for t, k in TOPICS.items())))

    general = lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("General")))
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda t: once(found(t), general))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n+"), lambda p: F.trim(p)), lambda p: p != "")


def sentences(text: Column, before_capital: bool = False) -> Column:
    """Split after . ! ? and white space; with before_capital only where a capital A-Z follows."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+" + ("(?=[A-Z])" if before_capital else "")), lambda s: s != "")


def whole_sentences(text: Column) -> Column:
    """As SQL parts a text, spaces around it taken off: after . ! ? where ASCII white space and a capital A-Z follow, and at
    U+0001. Blank lines part nothing, and an empty text is one empty sentence."""
    return F.split(F.regexp_replace(F.btrim(text, F.lit(SPACES)), r"([.!?])[ \t\n\f\r]+([A-Z])", "$1\x01$2"), "\x01")


def truncate_words(text: Column, n: int) -> Column:
    """At most n characters, cut at the last space before, with dots."""
    cut = F.substring(text, 1, n)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(cut, r"(?s)^(.*) .*$", "$1"), F.lit("...")))


def truncate_tokens(text: Column, max_tokens: int) -> Column:
    """About max_tokens tokens: cut at a paragraph end past 70 % of the length, else at a sentence end past 80 %, else sharply."""
    n = max_tokens * 4
    cut = F.substring(text, 1, n)
    tail = lambda mark: F.length(cut) - F.length(F.substring_index(cut, mark, -1)) - len(mark)
    para, stop = tail("\n\n"), tail(". ")
    return (
        F.when(F.length(text) <= n, text)
        .when((F.locate("\n\n", cut) > 0) & (para > 0.7 * n), F.substring(cut, F.lit(1), para))
        .when((F.locate(". ", cut) > 0) & (stop > 0.8 * n), F.substring(cut, F.lit(1), stop + 1))
        .otherwise(cut)
    )


def excerpt(text: Column, n: int) -> Column:
    """The first n characters, trimmed, with dots if the text is longer."""
    head = F.trim(F.substring(text, 1, n))
    return F.when(F.length(text) > n, F.concat(head, F.lit("..."))).otherwise(head)


def clean_markdown(text: Column) -> Column:
    """Without a leading block between lines of ---, with at most three line feeds in a row, trimmed."""
    bare = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    return F.btrim(F.regexp_replace(bare, "\n{4,}", "\n\n\n"), F.lit(" \n\t"))


def html_text(html: Column) -> Column:
    """Text of an HTML document: without scripts, styles, comments and tags; the common entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_title(html: Column) -> Column:
    """The first h1, h2 or title that has text of under 200 characters."""
    part = lambda tag: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", ""), r"\s+", " "))
    pick = lambda tag: F.when((F.length(part(tag)) > 0) & (F.length(part(tag)) < 200), part(tag))
    return F.coalesce(pick("h1"), pick("h2"), pick("title"))


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def glob_pattern(glob: str) -> str:
    """A regular expression of a case-sensitive glob with * ? and [...]."""
    out = re.sub(r"\\\[(.*?)\\\]", lambda m: "[" + m[1].replace("\\", "") + "]", re.escape(glob))
    return "(?s)^" + out.replace(r"\*", ".*").replace(r"\?", ".") + "$"


#: What a scan of JSON stops at: whole strings, comments, braces, and the mark of a fence.
_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|[{}]|```', re.S)


def _objects(text: str) -> Iterator[tuple[int, str]]:
    """(depth of fences, text without comments) of every balanced pair of braces, in order of where it opens.

    Braces, comments and fences inside strings are part of the strings; quotes outside of braces are prose.
    """
    open_at: list[tuple[int, int, bool]] = []
    parts: list[str] = []
    found: list[tuple[int, bool, int, int]] = []
    at, fenced, pos, size = 0, False, 0, 0
    while m := _JSON_TOKEN.search(text, pos):
        token, pos = m[0], m.end()
        if token[0] == '"' and not open_at:
            pos = m.start() + 1
        elif token[0] == "/":
            if open_at:
                parts.append(text[at : m.start()])
                size, at = size + m.start() - at, pos
            else:
                pos = m.start() + 2
        elif token == "```":
            fenced = not fenced and not open_at or fenced and bool(open_at)
        elif token == "{":
            open_at.append((m.start(), size + m.start() - at, fenced))
        elif token == "}" and open_at:
            start, a, inside = open_at.pop()
            found.append((start, inside, a, size + pos - at))
    bare = "".join(parts) + text[at:]
    for start, inside, a, b in sorted(found):
        yield (not inside, start), bare[a:b]


def first_json_object(text: str | None) -> str | None:
    """The first balanced object of an answer that is JSON, comments left out; one in a fence counts before others."""
    for _, found in sorted(_objects(text or "")):
        try:
            if isinstance(json.loads(found), dict):
                return found
        except ValueError:
            continue
    # A brace or quote in the prose before may have hidden the object: look from each brace on.
    for m in re.finditer(r"\{", text or ""):
        try:
            return text[m.start() : json.JSONDecoder().raw_decode(text, m.start())[1]]
        except ValueError:
            continue
    return None


def json_object(text: Column) -> Column:
    """The JSON object in an answer, or null."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def scanned(t: pd.Series) -> pd.Series:
        return t.map(first_json_object)

    return scanned(text)
