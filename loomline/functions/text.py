"""String functions over columns. Lengths count code points unless a function says UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming takes off: also the ideographic and the no-break space and the byte order mark.
SPACE = r"[\s　 ﻿]"
URL = r"https?://[^\s]+"
#: Commands, the type of message that each makes, its priority and whether it is completed; the first that fits decides.
COMMANDS = (
    ("/task_high", "task", "high", False), ("/task_medium", "task", "medium", False), ("/task_low", "task", "low", False), ("/task", "task", "medium", False),
    ("/task_completed", "task", "medium", True), ("/task_progress", "task", "medium", False), ("/document", "document", None, None), ("/session", "session", None, None),
)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def shortened(text: Column, most: int, mark: str = "...", kept: int | None = None) -> Column:
    """text, or its first characters and the mark where it is longer than ``most``."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most if kept is None else kept)), F.lit(mark))).otherwise(text)


def contains_ci(text: Column, part: str | Column) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(part) if isinstance(part, str) else part))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def url_label(url: Column) -> Column:
    """What a link shows: 47 characters and dots for more than 50."""
    return shortened(url, 50, kept=47)


def length_without_urls(text: Column) -> Column:
    return F.length(F.regexp_replace(text, URL, ""))


def title_of(text: Column) -> Column:
    return F.split(text, "\n")[0]


def body_of(text: Column) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")


def summary(text: Column, most: int = 100) -> Column:
    """A text of up to ``most`` characters as it is; else its first sentences, each ended again by a full stop, until one would go beyond; a cut with dots if not even the first fits."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(state, s):
        over = state["full"] | (F.length(state["text"]) + F.length(s) > most)
        return F.struct(F.when(over, state["text"]).otherwise(F.concat(state["text"], s, F.lit("。"))).alias("text"), over.alias("full"))

    found = F.aggregate(F.split(text, "[。！？\n]"), start, add, lambda s: s["text"])
    return F.when(F.length(text) <= most, text).when(found != "", found).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("...")))


def reading_minutes(characters: Column) -> Column:
    return F.ceil(characters / 400).cast("long")


def command_of(text: Column) -> Column:
    """struct(type, content, priority, completed) of an input: a command followed by white space, else plain text."""
    t = trimmed(text)
    made = lambda kind, content, priority, completed: F.struct(F.lit(kind).alias("type"), content.alias("content"), F.lit(priority).cast("string").alias("priority"), F.lit(completed).cast("boolean").alias("completed"))
    out = made("text", t, None, None)
    for word, kind, priority, completed in reversed(COMMANDS):
        content = trimmed(F.regexp_extract(t, rf"(?s)^{word}\s+(.*)$", 1))
        out = F.when(t.rlike(rf"(?s)^{word}\s+"), made(kind, content, priority, completed)).otherwise(out)
    return out


def quoted(text: Column) -> Column:
    """A text on one line of a copied log: over 200 characters cut to 100, line breaks written out, quotes doubled."""
    short = shortened(text, 200, kept=100)
    return F.concat(F.lit('"'), F.replace(F.replace(short, F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('""')), F.lit('"'))


def breadcrumb(names: Column, joiner: str = " > ") -> Column:
    return F.array_join(names, joiner)


def valid_image_url(url: Column) -> Column:
    """An absolute, rooted or data address that is not blank and no stand-in."""
    starts = F.lit(False)
    for prefix in ("http://", "https://", "/", "data:"):
        starts = starts | F.startswith(url, F.lit(prefix))
    return F.coalesce(starts & ~F.contains(url, F.lit("mockup_url")) & ~F.contains(url, F.lit("placeholder")), F.lit(False))


def dotted(*parts: Column) -> Column:
    """Parts that are not empty, joined by middle dots."""
    return F.concat_ws(" • ", *[F.nullif(p, F.lit("")) for p in parts])
