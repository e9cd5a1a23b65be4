"""Topic summaries of plain text: ordered heuristics over the first words, in one vectorised function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words the heuristics look for.
VERBS = {"is", "are", "was", "were", "has", "have", "contains", "provides"}
FILLERS = {"The", "the", "and", "but", "for", "with"}
TECHNICAL = ("implementation", "architecture", "system", "feature")
ACTIONS = {"provides", "combines", "implements", "uses", "creates", "enables"}
OFFERS = {"win", "get", "improve", "boost", "increase", "maximize", "enhance", "achieve", "unlock", "discover"}
SMALL = {"a", "an", "the", "and", "or", "but", "of", "in", "on", "at", "to", "for", "with", "from"}
DOES = {"harnesses", "uses", "transforms", "enables", "provides", "offers", "helps", "allows", "improves", "enhances", "discovers"}


def _cut(text: str, n: int = 50) -> str:
    return text if len(text) <= n else text[: n - 3] + "..."


def _capital(word: str) -> bool:
    return word[:1].isupper()


def topic_of(content: str) -> str | None:
    flat = re.sub(r"\*+|_+|~~|`|#", "", content)
    words = flat.split()
    if len(words) < 3:
        return None
    flat = " ".join(words)
    for rule in (_subject, _review, _named, _action, _audience, _headline, _title, _product):
        found = rule(flat, words, [x.strip() for x in content.splitlines() if x.strip()])
        if found:
            return _cut(found)
    return None


def _subject(flat: str, words: list[str], rows: list[str]) -> str | None:
    """The X is ..."""
    at = next((i for i, w in enumerate(words) if w in VERBS), 0)
    if not flat.startswith("The ") or not 1 < at <= 8:
        return None
    review = any(k in flat for k in ("well-", "review", "analysis")) and not any(k in flat for k in ("implementation", "architecture"))
    return f"{'Review' if review else 'About'}: {' '.join(words[1:at])}"


def _review(flat: str, words: list[str], rows: list[str]) -> str | None:
    kept = [w for w in words if len(w) > 2 and w not in FILLERS][:3]
    return f"Review: {' '.join(kept)}" if kept and "implementation" in flat and "functional" in flat else None


def _named(flat: str, words: list[str], rows: list[str]) -> str | None:
    names = [w for w in words if _capital(w) and len(w) > 2][:2]
    return f"{' '.join(names)} implementation" if len(names) == 2 and any(k in flat for k in TECHNICAL) else None


def _action(flat: str, words: list[str], rows: list[str]) -> str | None:
    first = words[0].lower()
    return f"Note: {' '.join(words[:5])}" if first in ACTIONS else " ".join(words[:6]) if first in OFFERS else None


def _audience(flat: str, words: list[str], rows: list[str]) -> str | None:
    return " ".join(words[:8]) if flat.startswith(("as a ", "for ")) else None


def _headline(flat: str, words: list[str], rows: list[str]) -> str | None:
    """A short first line and the second line's first sentence."""
    if len(rows) < 2 or not 2 <= len(rows[0].split()) <= 8:
        return None
    sentence = re.split(r"[.!?]", rows[1])[0].split()[:8]
    return f"{rows[0]}: {' '.join(sentence)}" if sentence else None


def _title(flat: str, words: list[str], rows: list[str]) -> str | None:
    first = rows[0].split() if rows else []
    if not 3 <= len(first) <= 10 or sum(map(_capital, first)) < len(first) // 2:
        return None
    keys = " ".join([w for w in first if w.lower() not in SMALL][:4])
    second = " ".join([w for w in rows[1].split() if len(w) > 3][:3]) if len(rows) > 1 else ""
    return f"{keys} - {second}" if keys and second else keys or None


def _product(flat: str, words: list[str], rows: list[str]) -> str | None:
    a, b = words[:2]
    if not _capital(a) or not (_capital(b) or b.lower() in ("ai", "ai,")):
        return None
    at = next((i for i, w in enumerate(words) if w.lower() in DOES), None)
    if at is not None and words[at + 1 :]:
        return f"{a} {words[at]} {' '.join(words[at + 1 : at + 5])}"
    rest = [w for w in words[2:] if len(w) > 2][:4]
    return f"{a} {b} - {' '.join(rest)}" if rest else None


@F.pandas_udf(StringType())
def _topics(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else topic_of(t))


def topic(content: Column) -> Column:
    return _topics(content)
