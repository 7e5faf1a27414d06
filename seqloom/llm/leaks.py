"""Evaluation passages inside corpus documents, found with an error budget and verified by edit distance.

A passage is a run of ``span`` words of a test item; an item of fewer words is one passage of all its words. With a budget
of k word edits a passage is split into k + 1 pieces; a document that holds it with at most k edits holds at least
one piece unchanged (pigeonhole). Pieces are hashes. Each document is read once: the hashes of its word runs of the
pieces' lengths are looked up in a bitmap of the pieces, whose size is fixed, and stretches of words around hits leave the
scan. Hits are joined with the pieces by hash, and Myers' bit-parallel algorithm over words decides in which distance a
stretch holds the passage.

Items are a table like the documents: neither goes to the driver. A larger test set fills the bitmap more, so more hits
reach the join that are none; nothing else changes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize

_WORD = re.compile(r"[^\W_]+")
#: The bitmap of piece hashes: 2**BITMAP_BITS bits in BITMAP_BLOCKS blocks.
BITMAP_BITS, BITMAP_BLOCKS = 26, 64
_STEP, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def piece_bounds(span: int, budget: int) -> list[tuple[int, int]]:
    """budget + 1 consecutive pieces of a passage of span words, as even as can be."""
    n = budget + 1
    if n > span:
        raise ValueError("the error budget needs more pieces than the passage has words")
    return [(span * i // n, span * (i + 1) // n) for i in range(n)]


def budget_of(words: int, span: int, budget: int) -> int:
    """Edits allowed in a passage of so many words: the budget, and of shorter items a share of it."""
    return budget * min(words, span) // span


def myers_best(pattern: Sequence, text: Sequence, budget: int) -> int:
    """Smallest edit distance, in words, of the pattern to any part of the text; budget + 1 if it is larger than budget.

    One machine word holds the column of a pattern of up to 64 words; Python's integers carry longer ones.
    """
    m = len(pattern)
    if m == 0:
        return 0
    peq: dict = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best = score
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask  # a match may begin anywhere in the text
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        best = min(best, score)
    return best if best <= budget else budget + 1


def myers_rows(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Smallest edit distance of pattern[i] to any part of text[i] for rows of word hashes, all of them at once.

    Patterns have at most 64 words; a text shorter than the others ends in zeros, which are no word.
    """
    n, m = pattern.shape
    one, mask, high = np.uint64(1), np.uint64((1 << m) - 1), np.uint64(1 << (m - 1))
    place = one << np.arange(m, dtype=np.uint64)
    pv, mv = np.full(n, mask), np.zeros(n, np.uint64)
    score = np.full(n, m)
    best = score.copy()
    for j in range(text.shape[1]):
        eq = ((pattern == text[:, j, None]) * place).sum(1, dtype=np.uint64)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        score += ((ph & high) > 0).astype(int) - ((mh & high) > 0)
        ph, mh = (ph << one) & mask, (mh << one) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        best = np.minimum(best, score)
    return best


class Words:
    """Texts as word hashes, one after the other; a worker hashes each different word once."""

    def __init__(self):
        import xxhash

        self.known: dict[str, int] = {}
        self.hash = xxhash.xxh3_64_intdigest

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, where each text begins; the last entry is the end)."""
        if len(self.known) > 1_000_000:  # a dictionary of words for speed only
            self.known.clear()
        known, out, ends = self.known, [], [0]
        for text in texts:
            words = words_of(text)
            for w in words:
                h = known.get(w)
                if h is None:
                    h = known[w] = self.hash(w) | 1  # never 0
                out.append(h)
            ends.append(len(out))
        return np.array(out, np.uint64), np.array(ends)


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the run of so many words that begins at each word; runs that would pass the end are left out."""
    n = max(0, len(words) - length + 1)
    out = np.full(n, np.uint64(length)) * _LENGTH
    for j in range(length):
        out = (out ^ words[j : j + n]) * _STEP
        out ^= out >> np.uint64(29)
    return out


def _slot(key: np.ndarray) -> np.ndarray:
    return key >> np.uint64(64 - BITMAP_BITS)


_PIECE = "item_id long, at int, piece_at int, size int, edits int, passage long, key long"


def _pieces(span: int, budget: int, least: int):
    """item_id, text -> a row for each piece of each passage; ``passage`` is the hash of its words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = Words()
        for batch in batches:
            words, ends = hashed(batch["text"].tolist())
            parts = []
            for item, a, b in zip(batch["item_id"].tolist(), ends[:-1], ends[1:]):
                size = min(span, int(b - a))
                if size < least:
                    continue
                own = words[a:b]
                edits, passage = budget_of(size, span, budget), runs(own, size)
                for low, high in piece_bounds(size, edits):
                    key = runs(own[low : len(own) - (size - high)], high - low)
                    parts.append(pd.DataFrame({"item_id": item, "at": np.arange(len(passage)), "piece_at": low, "size": high - low, "edits": edits, "passage": passage.view(np.int64), "key": key.view(np.int64)}))
            yield pd.concat(parts) if parts else pd.DataFrame({c.split()[0]: [] for c in _PIECE.split(", ")})

    return cut


def _bitmap(pieces: DataFrame) -> np.ndarray:
    """The bitmap of all keys, added up block by block; its size doesn't depend on the data."""
    step = (1 << BITMAP_BITS) // BITMAP_BLOCKS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << BITMAP_BITS, bool)
        for batch in batches:
            held[_slot(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))] = True
        blocks = [b for b in range(BITMAP_BLOCKS) if held[b * step : (b + 1) * step].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([np.packbits(held[b * step : (b + 1) * step]).tobytes() for b in blocks], pa.binary())], names=["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[block] = held.get(block, 0) | np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h.tobytes() for h in held.values()], pa.binary())], names=["block", "bits"])

    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in pieces.select("key").mapInArrow(mark, "block int, bits binary").repartition("block").mapInArrow(merge, "block int, bits binary").collect():  # 8 MB
        out[r["block"] * step // 8 : (r["block"] + 1) * step // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


_STRETCH = "doc long, stretch long, words array<long>, hits array<struct<at: int, key: long>>"


def _scanner(bitmap_of, lengths: list[int], margin: int):
    """doc, text -> stretches of words around runs that are in the bitmap, with those runs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hashed = bitmap_of.value, Words()
        kind = pa.list_(pa.struct([("at", pa.int32()), ("key", pa.int64())]))
        for batch in batches:
            words, ends = hashed(batch.column(1).to_pylist())
            docs, whose = batch.column(0), np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            at, key, size = [], [], []
            for length in lengths:
                runs_here = runs(words, length)
                slot = _slot(runs_here)
                hit = np.flatnonzero((bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1)
                hit = hit[whose[hit] == whose[np.minimum(hit + length - 1, len(whose) - 1)]] if len(hit) else hit
                at.append(hit), key.append(runs_here[hit]), size.append(np.full(len(hit), length))
            at, key, size = np.concatenate(at), np.concatenate(key), np.concatenate(size)
            order = np.argsort(at, kind="stable")
            at, key, size = at[order], key[order], size[order]
            if not len(at):
                continue
            low, high = np.maximum(at - margin, ends[whose[at]]), np.minimum(at + size + margin, ends[whose[at] + 1])
            top = np.maximum.accumulate(high)
            fresh = np.r_[True, (low[1:] >= top[:-1]) | (whose[at[1:]] != whose[at[:-1]])]  # windows that overlap are one stretch
            first = np.flatnonzero(fresh)
            begin, end = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            number = np.cumsum(fresh) - 1
            text = [words[a:b].view(np.int64) for a, b in zip(begin, end)]
            offsets = np.r_[0, np.cumsum(end - begin)].astype(np.int32)
            hits = pa.StructArray.from_arrays([pa.array((at - begin[number]).astype(np.int32)), pa.array(key.view(np.int64))], names=["at", "key"])
            doc = docs.take(pa.array(whose[at[first]]))
            where = (begin - ends[whose[at[first]]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([doc, pa.array(where), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(text))), pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)].astype(np.int32)), hits).cast(kind)], names=["doc", "stretch", "words", "hits"])

    return scan


_VERIFIED = "doc long, item_id long, edits int, held long"


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distances of passages to their windows, where within the budget; ``held`` is a passage that stands unchanged."""
    names = [c.split()[0] for c in _VERIFIED.split(", ")]
    for pdf in batches:
        out = [pd.DataFrame({n: np.zeros(0, np.int64) for n in names})]
        for (size, budget), some in pdf.groupby([pdf["pattern"].str.len(), "budget"]):
            window = np.zeros((len(some), size + 2 * budget), np.int64)
            for i, part in enumerate(some["window"]):
                window[i, : len(part)] = part
            best = myers_rows(np.array(some["pattern"].tolist(), np.int64), window)
            out.append(pd.DataFrame({"doc": some["doc"].to_numpy(), "item_id": some["item_id"].to_numpy(), "edits": best, "held": np.where(best == 0, some["passage"].to_numpy(), 0)})[best <= budget])
        yield pd.concat(out)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 13, budget: int = 1, short_items: bool = True) -> DataFrame:
    """(doc_id, item_id, best_edits, n_passages): every document and item of which it holds a passage with at most
    ``budget`` word edits; n_passages counts the item's passages that it holds unchanged.

    items has item_id (unique) and text. Items of fewer than span words are one passage, with budget * words // span
    edits, or without short_items none.
    A passage that occurs in more than one item does not count. Null or blank texts are never hit, and rows of either
    table without an id give none. Texts that repeat give a row each. Whole texts are read, whatever their length. Columns
    other than those named don't matter. Without documents or items the result is empty. span is at most 64.
    """
    if not budget < span <= 64:
        raise ValueError("span must be above budget and at most 64 words")
    spark = docs.sparkSession
    known = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    pieces = known.mapInPandas(_pieces(span, budget, 1 if short_items else span), _PIECE)
    pieces = materialize(pieces, "pieces")
    own = pieces.groupBy("passage").agg(F.count_distinct("item_id").alias("n")).filter("n = 1").select("passage")
    pieces = materialize(pieces.join(own, "passage"), "own")
    lengths = sorted(r[0] for r in pieces.select("size").distinct().collect())  # at most span
    plain = docs.filter(F.col(f"`{text}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    shipped = spark.sparkContext.broadcast(_bitmap(pieces))
    found = materialize(plain.mapInArrow(_scanner(shipped, lengths or [span], span + budget), _STRETCH), "stretches")
    stretch = [F.col("doc"), F.col("stretch")]
    hits = found.select(*stretch, F.explode("hits").alias("h")).select(*stretch, "h.at", "h.key")
    met = hits.withColumnRenamed("at", "hit_at").join(pieces.select("key", "item_id", "at", "piece_at", "edits", "passage"), "key")
    # each passage once for each place in which its pieces put it
    cases = met.select(*stretch, "item_id", "passage", "at", "edits", F.greatest(F.col("hit_at") - F.col("piece_at"), F.lit(0)).alias("begin")).distinct()
    own_words = known.mapInPandas(_word_lists, "item_id long, item_words array<long>")
    size, begin = F.least(F.size("item_words"), F.lit(span)), F.greatest(F.col("begin") - F.col("edits"), F.lit(0))
    window = F.slice("words", begin + 1, F.col("begin") + F.col("edits") + size - begin)
    whole = cases.join(found.select(*stretch, "words"), ["doc", "stretch"]).join(own_words, "item_id")
    whole = whole.select("doc", "item_id", "passage", F.col("edits").alias("budget"), window.alias("window"), F.slice("item_words", F.col("at") + 1, size).alias("pattern"))
    verified = whole.mapInPandas(_verify, _VERIFIED)
    return verified.groupBy(F.col("doc").alias(doc_id), "item_id").agg(F.min("edits").alias("best_edits"), F.count_distinct(F.when(F.col("edits") == 0, F.col("held"))).cast("int").alias("n_passages"))


def _word_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashed = Words()
    for batch in batches:
        words, ends = hashed(batch["text"].tolist())
        yield pd.DataFrame({"item_id": batch["item_id"], "item_words": [words[a:b].view(np.int64) for a, b in zip(ends[:-1], ends[1:])]})
