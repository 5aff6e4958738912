"""How quality filters interact: what each takes out in every order of them, and what it takes that it should not.

Texts are scanned as they lie in Arrow's buffers. Each byte has its classes from a table; prefix sums of the classes give each document's words,
capitals, signs and code points by two look-ups. Words become 64-bit hashes, sorted within each document; neighbours of equal hash are held against
each other byte by byte, so the number of distinct words is exact. A document ends as a mask of the filters that it fails. How many
documents of a part have each mask is all that any order of filters needs: the audit of a part is a product of its 32 counts with fixed matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need_columns, salted_lookup, ship, text_or_empty, written

#: Filters in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PER_100, CAPITALS_PER_100, SIGNS = 50, 65, 5, b"#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
#: Bytes of texts that are scanned together, and those beyond which a document is scanned in pieces.
TOGETHER, LARGE = 1 << 20, 16 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(SIGNS)] = True
_FIRST = np.ones(256, bool)
_FIRST[0x80:0xC0] = False  # bytes that continue a code point
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Before each byte, and after the last, how many bytes of a class there are."""
    out = np.zeros(len(data) + 1, np.int32)
    np.cumsum(table[data], out=out[1:], dtype=np.int32)
    return out


def _eights(padded: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each place the next eight bytes as a number, of which only ``length`` count."""
    every = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    keep = np.clip(length, 0, 8).astype(np.uint64) * np.uint64(8)
    all_ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    held = np.where(keep > 0, all_ones >> (np.uint64(64) - np.maximum(keep, np.uint64(8))), np.uint64(0))
    return every[np.minimum(at, len(every) - 1)] & held


def distinct_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, documents: int) -> np.ndarray:
    """How many different words each document has; words are given by place, length and document, in ascending order of documents."""
    if not len(starts):
        return np.zeros(documents, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    hashes, at, left = lengths.astype(np.uint64) * _MIX[0], np.arange(len(starts)), 0
    first = _eights(padded, starts, lengths)
    while len(at):  # eight bytes of all words that have them still, each time
        part = first if left == 0 else _eights(padded, starts[at] + left, lengths[at] - left)
        mixed = (hashes[at] ^ part) * _MIX[1]
        hashes[at] = (mixed ^ (mixed >> np.uint64(29))) * _MIX[2]
        left += 8
        at = at[lengths[at] > left]
        if left >= 64 and len(at):  # the rare longer ones one by one
            for i in at:
                hashes[i] = hash(data[starts[i] : starts[i] + lengths[i]].tobytes()) & 0xFFFFFFFFFFFFFFFF
            break
    order = np.lexsort((hashes, owner))
    hashes, lengths, first, starts, owner = hashes[order], lengths[order], first[order], starts[order], owner[order]
    like = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    same = like & (lengths[1:] == lengths[:-1]) & (first[1:] == first[:-1])
    pairs, left = np.flatnonzero(same & (lengths[1:] > 8)), 8
    while len(pairs):  # further bytes of those that are alike so far
        rest = lengths[pairs] - left
        equal = _eights(padded, starts[pairs] + left, rest) == _eights(padded, starts[pairs + 1] + left, rest)
        same[pairs[~equal]] = False
        pairs, left = pairs[equal & (rest > 8)], left + 8
    out = np.bincount(owner, minlength=documents) - np.bincount(owner[1:][same], minlength=documents)
    for i in np.unique(owner[1:][like & ~same]):  # one hash for different words: counted plainly
        own = np.flatnonzero(owner == i)
        out[i] = len({data[s : s + n].tobytes() for s, n in zip(starts[own], lengths[own], strict=True)})
    return out


def scan(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of each document, data[offsets[i]:offsets[i + 1]], its words, distinct words, capitals, signs and code points."""
    data = data[offsets[0] : offsets[-1]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    documents = len(offsets) - 1
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = word[inner]  # a document's first byte begins a word whatever stands before
    ends = word.copy()
    ends[:-1] &= ~word[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    of = lambda sums: (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64)
    counts = np.zeros(len(data) + 1, np.int32)
    np.cumsum(begins, out=counts[1:], dtype=np.int32)
    words = of(counts)
    owner = np.repeat(np.arange(documents), words)
    return {"words": words, "distinct": distinct_words(data, starts, lengths, owner, documents), "capitals": of(_sums(data, _CAPITAL)), "signs": of(_sums(data, _SIGN)), "code_points": of(_sums(data, _FIRST))}


def scan_large(data: np.ndarray, piece: int = LARGE) -> dict[str, np.ndarray]:
    """The same of one very long document, cut where there is white space, so that no more than its distinct words are held besides."""
    totals = dict.fromkeys(("words", "capitals", "signs", "code_points"), 0)
    known, at = set(), 0
    while at < len(data):
        stop = min(len(data), at + piece)
        while stop < len(data) and not _SPACE[data[stop]]:
            nearby = np.flatnonzero(_SPACE[data[stop : stop + piece]])
            stop = stop + int(nearby[0]) if len(nearby) else min(len(data), stop + piece)
        part = data[at:stop]
        known.update(part.tobytes().split())
        space = _SPACE[part]
        totals["words"] += int(np.count_nonzero(~space[1:] & space[:-1]) + (len(part) > 0 and not space[0]))
        for name, table in (("capitals", _CAPITAL), ("signs", _SIGN), ("code_points", _FIRST)):
            totals[name] += int(np.count_nonzero(table[part]))
        at = stop
    return {k: np.array([v]) for k, v in (totals | {"distinct": len(known)}).items()}


def _groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Documents that are scanned together: so many that they have about TOGETHER bytes, or one that has more."""
    at = 0
    while at < len(offsets) - 1:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOGETHER, side="right")) - 1)
        yield at, stop
        at = stop


def failures(texts: pa.Array) -> np.ndarray:
    """The mask of the filters A to D that each text fails; texts: of Arrow's large_string or string type, without nulls."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, kind)[texts.offset : texts.offset + len(texts) + 1] if offset_buffer is not None and offset_buffer.size else np.zeros(len(texts) + 1, kind)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    out = np.zeros(len(texts), np.int32)
    for a, b in _groups(offsets):
        large = b == a + 1 and offsets[b] - offsets[a] > LARGE
        x = scan_large(data[offsets[a] : offsets[b]]) if large else scan(data, offsets[a : b + 1])
        failed = (x["words"] < LEAST_WORDS, 100 * x["distinct"] < DISTINCT_PER_100 * x["words"], 100 * x["capitals"] > CAPITALS_PER_100 * x["code_points"], x["signs"] > 0)
        out[a:b] = sum(f.astype(np.int32) << i for i, f in enumerate(failed))
    return out


def failed_masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(_id, _part, _mask) for each row of df: the mask has a bit for each filter that the document fails, E being a text that a smaller id has too, anywhere in the table.

    Null texts count as empty and are copies of empty ones. A null id is no smaller than any and has none smaller: such rows neither fail E nor make others fail. Rows of
    one id and text do not make each other fail. A null part is the empty text.
    """
    need_columns(df, id_col, text_col, part_col)
    ship(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = pa.array(failures(b.column(0)), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], mask], [*b.schema.names[1:], "_mask"])

    text = text_or_empty(text_col)
    rows = df.select(text.alias("_text"), F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_digest"), F.octet_length(text).cast("long").alias("_bytes"), F.xxhash64(text).alias("_check"))
    scanned = written(rows.mapInArrow(work, "_id long, _part string, _digest binary, _bytes long, _check long, _mask int"), "masks")
    scanned = scanned.withColumn("_of_text", F.struct("_digest", "_bytes", "_check"))
    first = scanned.groupBy("_of_text").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).filter("_least < _most").select("_of_text", "_least")
    held = salted_lookup(scanned.select("_id", "_part", "_mask", "_of_text"), first, "_of_text", "_id")
    copy = F.coalesce(F.col("_least") < F.col("_id"), F.lit(False))
    return held.select("_id", "_part", F.col("_mask").bitwiseOR(F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("_mask"))


def matrices() -> dict[str, np.ndarray]:
    """For each order and step, whether a document of each mask counts: in rows the masks, in columns the steps of all orders."""
    masks = np.arange(MASKS)
    out = {name: np.zeros((MASKS, len(ORDERS) * len(FILTERS)), np.int64) for name in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for i, order in enumerate(ORDERS):
        gone = np.zeros(MASKS, bool)
        for step, letter in enumerate(order):
            c, bit = i * len(FILTERS) + step, 1 << FILTERS.index(letter)
            fails = masks & bit > 0
            out["removed"][:, c], out["redundant"][:, c], out["unique_fails"][:, c] = fails & ~gone, fails & gone, masks == bit
            gone |= fails
            out["kept"][:, c] = ~gone
    letters = np.array([FILTERS.index(x) for order in ORDERS for x in order])
    for f in range(len(FILTERS)):
        out["shapley"][:, letters == f] = out["removed"][:, letters == f].sum(1)[:, None]
    return out


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, each of the 120 orders and each step.

    labels: id_col, quality and toxic; a document is good or toxic if any of its rows there says 1. Documents without one are neither. See failed_masks for nulls and
    repeated rows: every row of df counts once. An empty table has no parts and gives no rows. Other columns may have any name.
    """
    need_columns(labels, id_col, "quality", "toxic")
    ship(df.sparkSession)
    masked = failed_masks(df, id_col, text_col, part_col)
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(one("quality").alias("_good"), one("toxic").alias("_toxic")).filter("_good OR _toxic")
    marked = salted_lookup(masked, marks, "_id", "_part", "_mask").groupBy("_part", "_mask").agg(F.count("*").alias("_all"), F.count_if("_good").alias("_good"), F.count_if("_toxic").alias("_toxic"))
    entry = F.struct("_mask", "_all", "_good", "_toxic")
    parts = marked.groupBy("_part").agg(F.collect_list(entry).alias("_counts"))  # 32 entries for a part at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, steps = matrices(), len(ORDERS) * len(FILTERS)
        orders, numbers = pa.array([o for o in ORDERS for _ in FILTERS]), pa.array(list(range(1, len(FILTERS) + 1)) * len(ORDERS), pa.int32())
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = np.zeros((3, MASKS), np.int64)
                for c in counts:
                    held[:, c["_mask"]] = c["_all"], c["_good"], c["_toxic"]
                numbered = [*(held[0] @ rules[name] for name in ("kept", "removed", "redundant", "unique_fails")), held[1] @ rules["removed"], held[2] @ rules["removed"], held[0] @ rules["shapley"]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * steps, pa.string()), orders, numbers, *(pa.array(x, pa.int64()) for x in numbered)], ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    return parts.mapInArrow(work, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: five filters over all documents, by source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(least < doc_id, false) AS e FROM words LEFT JOIN marks USING (doc_id)),
failed AS (SELECT part, good, toxic, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS f, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM docs),
counts AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
hits AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS hit, fails = letter AS single, len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND fails <> '' AND earlier <> '' AS gone FROM counts, steps),
audit AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN single THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM hits GROUP BY ALL)
SELECT * EXCLUDE letter, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM audit
"""
