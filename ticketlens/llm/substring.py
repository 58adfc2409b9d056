"""Repeated passages by relative Lempel-Ziv parsing.

Every document is parsed against the whole corpus as reference. A factor is a stretch that
also stands in a reference, at the place it names. It is taken greedily from left to right: of the
references that hold the words at hand, the one goes on that agrees the longest, until none does.
Where a factor ends, the parse steps back ``window - 1`` words and tries
the windows that cross the boundary, so that no repeated window is lost between two factors. Factors are
at least ``window`` words long; what they cover are the duplicate spans.

The index of reference blocks. The smallest hash of the ``seed`` consecutive words in a
window depends on the window's words alone, so two equal windows always have the same.
The windows of a document are cut into blocks where this smallest hash changes,
some two blocks for each window's length. A block is looked up by that hash:
- if no other block of the corpus has it, none of its windows is repeated,
- if another block has exactly the same words, all of its windows are; the first and the last
  such block of the corpus are the references,
- else its windows are compared, one hash each, with those of the blocks that share it.
Only the last kind is ever expanded into windows. All lookups are aggregations and
equi-joins on hashes, which combine before the shuffle: a passage that a third of all documents
share is no large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import settle
from .words import Words, chunks, sequence_hashes, signed, stretch_hashes


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, in log2(width) passes."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def blocks(words: Words, window: int, seed: int, longest: int = 64) -> tuple[np.ndarray, ...]:
    """The blocks of some texts: (text, first window in the text, number of windows, key, hash of the words, ties).

    A block is cut after ``longest`` windows; only repetitive text reaches that. Ties
    mark blocks in which the smallest hash may stand twice, so that a window may equal
    another of the same block.
    """
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    seeds = sequence_hashes(words.hash, seed)
    if len(words.hash) < window:
        return empty
    least = _sliding_least(seeds, window - seed + 1)  # one per window
    text = words.text_of()
    starts = np.flatnonzero(text[: len(least)] == text[window - 1 :])
    if not len(starts):
        return empty
    key, owner = least[starts], text[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    sizes = np.diff(np.append(run, len(starts)))
    if sizes.max() > longest:
        at = np.arange(len(starts)) - np.repeat(run, sizes)
        run = np.flatnonzero(at % longest == 0)
        sizes = np.diff(np.append(run, len(starts)))
    begin = starts[run]
    # The least value stands twice where it also holds before and after leaving out its place.
    same = np.zeros(len(seeds) + 1, np.int64)
    peak = -_sliding_least(-np.pad(least.astype(np.float64), window - seed, constant_values=-1.0), window - seed + 1)
    anchor = np.flatnonzero(seeds.astype(np.float64) == peak[: len(seeds)])
    near = anchor[:-1][(seeds[anchor[1:]] == seeds[anchor[:-1]]) & (np.diff(anchor) <= window + longest)]
    same[near + 1] = 1
    same = np.cumsum(same)
    ties = same[np.minimum(begin + sizes + window - seed, len(seeds))] > same[begin]
    return owner[run], begin - words.first[owner[run]], sizes, key[run], stretch_hashes(words.hash, begin, sizes + window - 1), ties


def _identity() -> Column:
    """Names a row by 128 bits of its id and text, alike in every scan; equal rows share it."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    whole = F.concat(F.coalesce(F.length(F.col("doc_id").cast("string")), F.lit(-1)), F.lit(":"), name, F.coalesce(F.col("text"), F.lit("")))
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


#: Names a row in every intermediate table.
ROW = "row_identity"
_WANTED = f"{ROW}_wanted"


def _block_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(batch, "text"):
                text, begin, windows, key, content, ties = blocks(words, window, seed)
                of = pa.array(words.lo + text)
                columns = [begin.astype(np.int32), windows.astype(np.int32), signed(key), signed(content), ties]
                arrays = [*(batch.column(c).take(of) for c in (ROW, "doc_id")), *(pa.array(c) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, [ROW, "doc_id", "begin", "windows", "key", "words", "ties"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(ROW, "doc_id", "text").mapInArrow(cut, f"{ROW} binary, doc_id {kind}, begin int, windows int, key long, words long, ties boolean")


def _windows(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(row, doc_id, at, key, window, copies) of the windows of the wanted blocks, their documents read once more.

    The documents are joined whole, and kept if nothing is wanted of them: so they are dealt out by row as for the result of
    :func:`remove_repeats`, and one shuffle serves both.
    """
    lists = wanted.groupBy(ROW).agg(F.collect_list(F.struct("begin", "windows", "copies", "key")).alias(_WANTED))
    rows = texts.join(lists, ROW, "left")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(_WANTED).is_valid())
            if not batch.num_rows:
                continue
            lists = batch.column(_WANTED)
            fields = [np.asarray(lists.flatten().field(x)) for x in ("begin", "windows", "copies", "key")]
            edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for words in chunks(batch, "text"):
                hashes = sequence_hashes(words.hash, window)
                lo, hi = edge[words.lo], edge[words.hi]
                begin, count, copies, key = (x[lo:hi].astype(np.int64) for x in fields)
                text = np.repeat(np.arange(words.lo, words.hi), np.diff(edge[words.lo : words.hi + 1]))
                each = np.repeat(np.arange(hi - lo), count)
                at = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                found = hashes[words.first[text[each] - words.lo] + at]
                of = pa.array(text[each])
                arrays = [*(batch.column(c).take(of) for c in (ROW, "doc_id")), *(pa.array(c) for c in (at.astype(np.int32), key[each], signed(found), copies[each]))]
                yield pa.RecordBatch.from_arrays(arrays, [ROW, "doc_id", "at", "key", "window", "copies"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(expand, f"{ROW} binary, doc_id {kind}, at int, key long, window long, copies long")


def _source(id: str, at: str) -> Column:
    return F.struct(F.col(id).alias("id"), F.col(at).alias("at"))


def stretches(texts: DataFrame, window: int = 35, seed: int = 8) -> DataFrame:
    """(row, start, n_windows, sources): stretches of windows that also start elsewhere, and where.

    ``texts`` has row, doc_id, text and any others; equal rows count as two documents. Each stretch is one
    block's, or a window within a block. Its sources are the first and the last (id, word number) in the corpus with the same
    words, one of which may be the stretch itself.
    """
    cut = _block_rows(texts, window, seed)
    keys = cut.groupBy("key").agg(F.count("*").alias("n"), F.max("ties").alias("ties")).where("n > 1 or ties")
    shared = settle(cut.join(keys.select("key"), "key").select(ROW, "doc_id", "begin", "windows", "key", "words", "ties"), "blocks")

    distinct = shared.groupBy("key", "words").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "begin", ROW, "windows", "ties")).alias("first"), F.max(F.struct("doc_id", "begin")).alias("last")
    )
    distinct = settle(distinct.select("key", "words", "copies", "first.*", "last"), "distinct")
    whole = distinct.where("copies > 1").select("key", "words", F.array(_source("doc_id", "begin"), _source("last.doc_id", "last.begin")).alias("sources"))
    full = shared.join(whole, ["key", "words"]).select(ROW, F.col("begin").alias("start"), F.col("windows").alias("n_windows"), "sources")

    # Blocks that are alone with their words, and those that could hold the same windows.
    alone = distinct.groupBy("key").agg(F.min("copies").alias("least"), F.count("*").alias("blocks"), F.max("ties").alias("ties"))
    open_keys = alone.where("least = 1 and (blocks > 1 or ties)").select("key")
    wanted = distinct.join(open_keys, "key", "left_semi").select(ROW, "begin", "windows", "copies", "key")
    seen = _windows(texts, wanted, window)
    # Equal windows have equal keys, so both name a window: 128 bits.
    place = F.struct("doc_id", "at")
    repeated = seen.groupBy("key", "window").agg(F.sum("copies").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).where("n > 1")
    repeated = repeated.select("key", "window", F.array(_source("first.doc_id", "first.at"), _source("last.doc_id", "last.at")).alias("sources"))
    single = seen.where("copies = 1").select(ROW, "at", "key", "window").join(repeated, ["key", "window"])
    return full.union(single.select(ROW, F.col("at").alias("start"), F.lit(1).alias("n_windows"), "sources"))


def parse(found: list[dict], own: object, window: int) -> list[dict]:
    """The factors of one document from its stretches of repeated windows, which do not overlap.

    A source goes on where it is the same document at the same distance; a factor ends where none of its sources does. The
    place itself is a source only of rows that are repeated whole.
    """
    out: list[dict] = []
    live: set[tuple] = set()
    begin = after = 0

    def close() -> None:
        if live:
            source, distance = min(live, key=lambda d: (d[0] is not None, d))
            out.append({"start": begin, "end": after + window - 1, "source_id": source, "source_start": begin + distance})

    for stretch in sorted(found, key=lambda s: s["start"]):
        start = stretch["start"]
        sources = {(s["id"], s["at"] - start) for s in stretch["sources"]}
        sources = sources - {(own, 0)} or sources
        longer = live & sources if start == after else set()
        if not longer:
            close()
            begin = start
        live, after = longer or sources, start + stretch["n_windows"]
    close()
    return out


def covered(factors: list[dict]) -> list[tuple[int, int]]:
    """What factors cover, from left to right: those that meet or overlap, such as across a boundary, are one span."""
    out: list[tuple[int, int]] = []
    for factor in factors:
        if out and factor["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], factor["end"])
        else:
            out.append((factor["start"], factor["end"]))
    return out


def remove_repeats(docs: DataFrame, window: int = 35, seed: int = 8, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed, factors, spans, kept_sha256 and kept_text: what is left after all repeated windows went.

    Words are runs without ASCII white space; a null text has none. Every word is removed that a
    window of ``window`` words covers whose words also start at another place, in
    any document; both places go. Windows are judged on the input. ``factors`` are (start, end, source_id, source_start): the words from
    start to end stand in the document source_id from source_start on. ``spans`` are the
    removed stretches (start, end) in words, which the factors cover; ``kept_text`` joins the kept words by one
    space, and is the text itself where nothing was removed (null without ``keep_text``). Equal rows are
    two places. Other columns are carried through; those named as one that is added are
    replaced. Eager: it writes the shared blocks.
    """
    added = ["n_words", "n_removed", "factors", "spans", "kept_sha256", "kept_text"]
    base = docs.drop(*[c for c in docs.columns if c.lower() in {*added, ROW, _WANTED, "found"}])
    rows = base.withColumn(ROW, _identity())
    found = stretches(rows, window, seed)
    # The set combines before the shuffle: equal rows, however many, have one list.
    lists = found.groupBy(ROW).agg(F.collect_set(F.struct("start", "n_windows", "sources")).alias("found"))
    joined = rows.join(lists, ROW, "left")
    fields = base.schema.fields
    kind = base.schema["doc_id"].dataType.simpleString()
    factor, span = f"array<struct<start:long,end:long,source_id:{kind},source_start:long>>", "array<struct<start:long,end:long>>"
    new = T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in zip(added, ["long", "long", factor, span, "string", "string"], strict=True))).fields

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in added]
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, own, found in zip(texts, batch.column("doc_id").to_pylist(), batch.column("found").to_pylist(), strict=True):
                words = (text or b"").split()
                parsed = parse(found or [], own, window)
                spans = covered(parsed)
                kept, at = [], 0
                for start, end in spans:
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                whole = b" ".join(kept)
                left = (whole if spans else text) if keep_text else None
                values = (len(words), len(words) - len(kept), parsed, [{"start": s, "end": e} for s, e in spans], hashlib.sha256(whole).hexdigest(), left)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [*(to_arrow_type(f.dataType) for f in new[:4]), pa.string(), pa.binary()]
            arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
            arrays[-1] = arrays[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *arrays], [*(f.name for f in fields), *added])

    schema = T.StructType([*fields, *new])
    return joined.select(*(F.col(f"`{f.name}`") for f in fields), "found").mapInArrow(clean, schema)
