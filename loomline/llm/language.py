"""Language identification by Bayesian fusion of evidence.

The posterior of a language is made of four parts: how likely the letters of the whole text are (naive Bayes over hashed letter
trigrams, tempered, as trigrams of one text are far from independent); how likely the declared markup language is; how likely the
suffix of the address is; and a prior for the host, smoothed towards its domain, that towards its suffix and that towards all
rows. Every table of counts comes from grouped aggregation over all rows. A row's own verdict is taken out of
its host's counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need_columns, salted_lookup, ship, written

#: Hashed trigrams that are told apart; languages whose counts a task holds at a time before it hands them on.
BUCKETS, HELD_LANGUAGES = 1 << 14, 200
#: Trigrams whose joint evidence the longest text comes near to.
EVIDENCE = 150.0
#: Rows that a level of the host hierarchy gets from the level above it.
SMOOTHING = 8.0
UNKNOWN = "und"

_KEEP = np.zeros(1 << 16, bool)
_KEEP[[*range(97, 123)]] = True
_KEEP[0xAA:0x2000] = True
_KEEP[0x2C00:0xD800] = True
_KEEP[0xF900:0xFFFE] = True
_KEEP[[0xAB, 0xAC, 0xAD, 0xAE, 0xAF, 0xB0, 0xB1, 0xB4, 0xB6, 0xB7, 0xB8, 0xBB, 0xBF, 0xD7, 0xF7]] = False


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of a whole text; words are lower-cased and parted by one blank each."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letters = np.where((points >= 1 << 16) | _KEEP[np.minimum(points, 0xFFFF)], points, 32).astype(np.uint32)
    letters = np.concatenate([[32], letters, [32]]).astype(np.uint32)
    letters = letters[np.r_[True, (letters[1:] != 32) | (letters[:-1] != 32)]]
    if len(letters) < 3:
        return np.empty(0, np.int64)
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    h = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(18)).astype(np.int64)[b != 32]


def primary(column: Column) -> Column:
    """The primary subtag of a language tag in small letters, or null: "de-AT" and "DE" are "de"."""
    tag = F.regexp_extract(F.lower(F.trim(column)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.nullif(tag, F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def suffix_of(url: Column) -> Column:
    """What the address says of the language: the first path segment if it is a language tag, else the last label of the host."""
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:-[a-z]{2})?(?:[/?#]|$)", 1)
    return F.when(path != "", F.concat(F.lit("/"), path)).otherwise(F.nullif(F.regexp_extract(host_of(url), r"\.([a-z0-9-]+)$", 1), F.lit("")))


def markup_language(html: Column) -> Column:
    """The lang attribute of the html element, which stands near the top, or else the content-language that a meta element declares."""
    attribute = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    meta = F.regexp_extract(html, r"""(?is)<meta\b[^>]*?http-equiv\s*=\s*["']?content-language["']?[^>]*?content\s*=\s*["']?([A-Za-z_-]+)""", 1)
    return F.coalesce(F.nullif(attribute, F.lit("")), F.nullif(meta, F.lit("")))


_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|nav|footer|head)\b.*?(?:</\1\s*>|\Z)|<[^>]*>", re.S | re.I)


def visible(text: str, html: bool) -> str:
    return unescape(_MARKUP.sub(" ", text)) if html else text


#: Characters of a text that are looked at together, on to the next white space.
PIECE = 1 << 20
_BLANK = re.compile(r"\s")


def pieces(text: str) -> Iterator[str]:
    """A text in pieces that end at white space, which have the same trigrams as the whole."""
    at = 0
    while len(text) - at > PIECE and (found := _BLANK.search(text, at + PIECE)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def trigram_counts(text: str) -> np.ndarray:
    return sum(np.bincount(trigrams(x), minlength=BUCKETS) for x in pieces(text))


class Likelihood:
    """Log probabilities of trigram buckets by language, from counts over all rows that declare one."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(0) + 1.0
        share = total / total.sum()
        self.log = np.log((counts + 500.0 * share) / (counts.sum(1, keepdims=True) + 500.0)).T.astype(np.float32)  # bucket by language

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """Number of trigrams and the tempered log likelihood of each language."""
        n, total = 0, np.zeros(len(self.languages))
        for x in pieces(text):
            grams = trigrams(x)
            n += len(grams)
            total += self.log[grams].sum(0, dtype=np.float64) if len(grams) < BUCKETS // 4 else np.bincount(grams, minlength=BUCKETS) @ self.log.astype(np.float64)
        return n, total / (1 + n / EVIDENCE)


#: Rows that a worker has as Python objects at a time.
SLICE = 256


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def learn(rows: DataFrame, html: bool) -> Likelihood:
    """rows: _text and _declared. Counts of hashed trigrams by declared language over all rows, grouped on the executors.

    Every declared language is learnt, however rare: smoothing leaves one with little text near to what all languages have in common.
    """
    languages = sorted(r["_declared"] for r in rows.filter("_declared is not null").select("_declared").distinct().collect())  # tags of two or three letters
    at = {x: i for i, x in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for i, own in counts.items():
                held = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), i), pa.int32()), pa.array(held, pa.int32()), pa.array(own[held], pa.int64())], ["l", "h", "n"])
            counts.clear()

        for b in sliced(batches):
            for text, tag in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if at[tag] not in counts:
                    if len(counts) >= HELD_LANGUAGES:
                        yield from handed_on()
                    counts[at[tag]] = np.zeros(BUCKETS, np.int64)
                counts[at[tag]] += trigram_counts(visible(text or "", html))
        yield from handed_on()

    table = np.zeros((len(languages), BUCKETS))
    summed = rows.filter("_declared is not null").select("_text", "_declared").mapInArrow(work, "l int, h int, n long").groupBy("l", "h").agg(F.sum("n").alias("n"))
    for r in summed.toLocalIterator():  # languages * buckets rows at most
        table[r["l"], r["h"]] = r["n"]
    return Likelihood(languages, table)


#: What stands for the evidence beside the text: rows that share these and the verdict of the text share all of it.
GROUP = ["_declared", "_host", "_suffix", "_best"]


def _with_likelihoods(rows: DataFrame, shared, at: int, kept: list[str], html: bool) -> DataFrame:
    """Columns kept of rows, with _n, _best and _log (a number for each language) of the text in column ``at``."""
    schema = rows.select(*kept).withColumns({"_n": F.lit(0).cast("long"), "_best": F.lit(0), "_log": F.array().cast("array<float>")}).schema
    places = [rows.columns.index(c) for c in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches):
            n, log = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, len(m.languages)), np.float32)
            for i, text in enumerate(b.column(at).to_pylist()):
                n[i], log[i] = m.of(visible(text or "", html))
            ends = pa.array(np.arange(b.num_rows + 1) * log.shape[1], pa.int32())
            best = np.where(n > 0, log.argmax(1), -1)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in places), pa.array(n), pa.array(best, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(log.ravel()))], schema.names)

    return rows.mapInArrow(work, schema)


def _evidence(scored: DataFrame, languages: list[str]) -> DataFrame:
    """For each group of scored rows (GROUP) the logarithms of what host, domain, suffix and declared tag say of each language.

    Counted over all rows: groups first, so that a host, suffix or tag that a third of all rows share is one row for each verdict of few groups.
    """
    groups = written(scored.groupBy(*GROUP).agg(F.count("*").alias("_rows")), "groups")
    groups = groups.withColumn("_domain", F.coalesce(F.nullif(domain_of(F.col("_host")), F.lit("")), F.col("_host")))

    def verdicts(by: str, name: str) -> DataFrame:
        """One row for each value of ``by``: how many rows have which language by their text, as a map without those that none has."""
        n = groups.filter(F.col(by).isNotNull()).groupBy(by, "_best").agg(F.sum("_rows").alias("n"))
        return n.groupBy(by).agg(F.map_from_entries(F.collect_list(F.when(F.col("_best") >= 0, F.struct("_best", "n")))).alias(name))

    overall = np.zeros(len(languages))
    for r in groups.filter("_best >= 0").groupBy("_best").agg(F.sum("_rows").alias("n")).collect():  # a row for each language at most
        overall[r["_best"]] = r["n"]
    out = groups
    for by, name in (("_host", "_of_host"), ("_domain", "_of_domain"), ("_suffix", "_of_suffix"), ("_declared", "_of_tag")):
        out = salted_lookup(out, verdicts(by, name), by, *GROUP)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (overall + 1) / (overall.sum() + len(languages))

        def counted(held: list[tuple[int, int]]) -> np.ndarray:
            n = np.zeros(len(languages))
            for i, many in held:
                n[i] = many
            return n

        for b in sliced(batches):
            r = b.to_pydict()
            log = np.zeros((b.num_rows, len(languages)), np.float32)
            for i, best in enumerate(r["_best"]):
                own = np.zeros(len(languages))  # a row's own verdict says nothing of its host
                if best >= 0:
                    own[best] = 1
                prior = base
                for level in ("_of_suffix", "_of_domain", "_of_host"):
                    if r[level][i] is not None:
                        n = np.maximum(counted(r[level][i]) - own, 0)
                        prior = (n + SMOOTHING * prior) / (n.sum() + SMOOTHING)
                log[i] = np.log(prior)
                if r["_of_tag"][i] is not None:
                    log[i] += np.log((counted(r["_of_tag"][i]) + base) / (overall + 1))
            ends = pa.array(np.arange(b.num_rows + 1) * log.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in GROUP), pa.ListArray.from_arrays(ends, pa.array(log.ravel()))], [*GROUP, "_evidence"])

    out = out.select(*GROUP, "_of_host", "_of_domain", "_of_suffix", "_of_tag").mapInArrow(work, "_declared string, _host string, _suffix string, _best int, _evidence array<float>")
    return out.select(F.struct(*GROUP).alias("_group"), "_evidence")


def _judged(scored: DataFrame, evidence: DataFrame, languages: list[str], least: float) -> DataFrame:
    """scored with language, posterior and accepted. A small evidence is sent to all tasks, a large one meets rows that Spark splits where a group is hot."""
    fused = scored.withColumn("_group", F.struct(*GROUP)).join(evidence, "_group", "left")
    fused = fused.withColumn("_sum", F.zip_with("_log", "_evidence", lambda a, b: a.cast("double") + b.cast("double")))
    fused = fused.withColumn("_top", F.array_max("_sum"))
    share = 1 / F.aggregate("_sum", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("_top")))
    fused = fused.withColumn("posterior", F.when(F.col("_n") > 0, share).otherwise(0.0)).withColumn("accepted", (F.col("_n") > 0) & (F.col("posterior") >= least))
    found = F.element_at(F.array(*map(F.lit, languages)), F.array_position("_sum", F.col("_top")).cast("int"))
    return fused.withColumn("language", F.when(F.col("accepted"), found).otherwise(UNKNOWN))


def _read(df: DataFrame, text_col: str, declared: Column | None, host: Column | None, suffix: Column | None, *more: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        *more, F.col(text_col).cast("string").alias("_text"), (none if declared is None else primary(declared)).alias("_declared"), (none if host is None else host.cast("string")).alias("_host"), (none if suffix is None else suffix.cast("string")).alias("_suffix")
    )


def identify(df: DataFrame, id_col: str, text_col: str, declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, html: bool = False, least: float = 0.5) -> DataFrame:
    """One row per row of df: id (long), language, posterior, declared, text_language, n_trigrams and accepted.

    declared: a language tag that the document claims; host: where it is from; suffix: the end of its address. Each may be
    missing, as a whole or by row, and then says nothing. html: whether texts are markup.
    language is "und", and the row is not accepted, if the text has no letters or no language is likelier than ``least``. Nulls and
    empty texts are "und". Repeated rows stay; an empty table, or one that declares no language at all, gives "und" for every row.
    """
    need_columns(df, id_col, text_col)
    ship(df.sparkSession)
    rows = _read(df, text_col, declared, host, suffix, F.col(id_col).cast("long").alias("_id"))
    model = learn(rows, html)
    languages = model.languages
    if not languages:
        blank = [F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"), F.col("_declared").alias("declared"), F.lit(UNKNOWN).alias("text_language"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("accepted")]
        return rows.select(F.col("_id").alias(id_col), *blank)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 64 KB for each language
    scored = written(_with_likelihoods(rows, shared, 1, ["_id", "_declared", "_host", "_suffix"], html), "likelihoods")
    out = _judged(scored, _evidence(scored, languages), languages, least)
    text = F.when(F.col("_best") >= 0, F.element_at(F.array(*map(F.lit, languages)), F.greatest("_best", F.lit(0)) + 1)).otherwise(UNKNOWN)
    return out.select(F.col("_id").alias(id_col), "language", "posterior", F.col("_declared").alias("declared"), text.alias("text_language"), F.col("_n").alias("n_trigrams"), "accepted")


def keep_identified(df: DataFrame, text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, html: bool = False, least: float = 0.5) -> DataFrame:
    """The rows of df that identify() accepts, with all columns of df under whatever names.

    Each row is judged where it is: texts are scored once for the counts and again, with all columns, for the verdict, so that no
    text is shuffled for as long as Spark can send the table of evidence to all tasks. Rows whose text is null or empty go, and all do if no language is declared.
    """
    need_columns(df, text_col)
    ship(df.sparkSession)
    rows = _read(df, text_col, declared, host, suffix)
    model = learn(rows, html)
    if not model.languages:
        return df.filter(F.lit(False))
    shared = df.sparkSession.sparkContext.broadcast(model)
    scored = _with_likelihoods(rows, shared, 0, ["_declared", "_host", "_suffix"], html)
    evidence = written(_evidence(scored, model.languages), "evidence")
    own = [f"c{i}" for i in range(len(df.columns))]
    # all columns by place: theirs may have the names of those here
    whole = _read(df, text_col, declared, host, suffix, *(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))
    whole = whole.toDF(*own, "_text", "_declared", "_host", "_suffix").drop("_text")
    out = _judged(_with_likelihoods(whole, shared, df.columns.index(text_col), [*own, "_declared", "_host", "_suffix"], html), evidence, model.languages, least)
    return out.filter("accepted").select(*own).toDF(*df.columns)


def identify_documents(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents: lang is what they declare, source is their host."""
    return identify(df, id_col, "text", F.col("lang"), F.col("source"))


def identify_pages(df: DataFrame) -> DataFrame:
    """Pages: the lang attribute of the markup, the suffix and host of the address, and the visible text."""
    return identify(df, "page_id", "html", markup_language(F.col("html")), host_of(F.col("url")), suffix_of(F.col("url")), html=True)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents."""
    return identify_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pages_query(spark, sf_dir: str) -> DataFrame:
    """All pages, with the evidence of markup and addresses."""
    return identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
