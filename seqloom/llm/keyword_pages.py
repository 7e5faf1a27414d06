"""Pages of repeated keywords, links or product tags, told from sentences by corpus statistics of neighbouring words.

Three measures of the words around a word decide whether it stands among keywords.

* Mean pointwise mutual information of neighbours, over that of the swapped order. PMI alone doesn't separate sentences
  from templates and spam with a small vocabulary (both have a high mean). In sentences a pair has a far higher PMI in
  its own order than the other way round; in word salad the order says nothing. The words of a window in which the mean
  of that surplus is GAIN bits or more are coherent and never keywords.
* Order-free neighbours. For each word, ``loose`` is the share of its neighbour mass that is as likely in the swapped
  order; a word next to itself counts as loose. How often a word stands in windows of high mean looseness is its
  ``affinity``, which reaches tags and codes that have an order of their own but live among keywords. Where the mean
  affinity is high and the text isn't coherent, the words are keywords. Links count as one word and are always loose.
* Repeated collocations. A phrase repeated in a fixed order is coherent and has no loose words, so excessive
  repetition is judged within the page: neighbours that stand together REPEATS times within WITHIN words are a repeated
  collocation, and an unbroken run of at least RUN words of such collocations is keywords in any case. Numbers end a run
  and words keep their digits here: lists, log lines and prose from templates repeat much as well, but have a number, a
  name or a code that differs every few words.

Texts are split into words once; from then on they are arrays of word hashes. Counts cover all documents and every word
and pair has a score. A score from few occurrences is weak: window means are taken over the words with LEAST_COUNT
occurrences, and again over all words, each weighted by n / (n + EVIDENCE) of its n occurrences; the higher mean counts.
Words with at least total / MAX_WORDS occurrences, of which there are at most MAX_WORDS, and pairs likewise, are shipped
to the workers; the scores of rarer ones are joined to the texts they stand in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize

MAX_WORDS, MAX_PAIRS, LEAST_COUNT, EVIDENCE = 200_000, 1_000_000, 20, 5
#: Words on each side of a window, and known words that a mean is taken over at least.
SIDE, LEAST_KNOWN = 7, 4
LOOSE, AFFINE, MOST = 0.15, 0.4, 0.5
#: Bits of PMI over the swapped order with which a window is coherent; occurrences of a pair that count half; neighbour
#: pairs of a corpus as large as which GAIN is meant for.
GAIN, PAIR_EVIDENCE, PAIRS_OF_GAIN = 6.0, 2, 1_000_000
#: A collocation is repeated excessively if it stands so many times within so many words; words in a run at least.
REPEATS, WITHIN, RUN = 5, 400, 16
_TOKEN = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]|]+|[^\W_]+")
#: Hashes of a link and of a number; those of words are larger.
URL, NUMBER = 1, 2


class Tokens:
    """Texts as word hashes, one after the other. A worker looks at each different word once."""

    def __init__(self):
        import xxhash

        self.hash, self.known, self.kinds = xxhash.xxh3_64_intdigest, {}, []

    def _kind(self, word: str) -> tuple[int, int, int, bool]:
        """(hash of the word, hash with its digits, words that it stands for, whether it is a number). A link is one word,
        digits at the end are cut off; Chinese has no word breaks, two of its characters count as a word."""
        number = lambda w: (self.hash(w) >> 2) + 3
        if word.startswith(("http://", "https://", "www.")):
            return URL, number(word), 1, False
        bare = word.rstrip("0123456789")
        return number(bare) if bare else NUMBER, number(word), max(1, len(word) // 2) if "\u3400" <= word[0] <= "\u9fff" else 1, word.isdigit()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(hash, hash with digits, weight, is a number) of all words, and where each text begins; the last entry is the end."""
        if len(self.kinds) > 1_000_000:  # for speed only
            self.known, self.kinds = {}, []
        known, kinds, out, ends = self.known, self.kinds, [], [0]
        for text in texts:
            for w in _TOKEN.findall(text.lower()):
                k = known.get(w)
                if k is None:
                    k = known[w] = len(kinds)
                    kinds.append(self._kind(w))
                out.append(k)
            ends.append(len(out))
        table = np.array(kinds, np.int64).reshape(-1, 4)[np.array(out, np.int64)]
        return table[:, 0], table[:, 1], table[:, 2], table[:, 3] > 0, np.array(ends)


def _pairs(words: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places i of neighbours i, i + 1 in one text, a number for each different pair of a text)."""
    at = np.flatnonzero(whose[:-1] == whose[1:]) if len(words) > 1 else np.zeros(0, np.int64)
    small = np.unique(words, return_inverse=True)[1].ravel().astype(np.int64)
    pair = small[at] * (small.max(initial=0) + 1) + small[at + 1]
    pair = np.unique(pair, return_inverse=True)[1].ravel().astype(np.int64)
    return at, whose[at] * (pair.max(initial=0) + 1) + pair


def repeated_words(words: np.ndarray, number: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word whether it stands in a run of collocations that are repeated excessively. words keep their digits."""
    on = np.zeros(len(words), bool)
    whose = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at, pair = _pairs(words, whose)
    fit = ~(number[at] | number[at + 1]) if len(at) else np.zeros(0, bool)
    at, pair = at[fit], pair[fit]
    order = np.argsort(pair, kind="stable")
    at, pair = at[order], pair[order]
    last = REPEATS - 1
    if len(at) <= last:
        return on
    many = np.flatnonzero((pair[last:] == pair[:-last]) & (at[last:] - at[:-last] < WITHIN))
    for k in range(REPEATS):
        on[at[many + k]] = on[at[many + k] + 1] = True
    edge = np.r_[True, (on[1:] != on[:-1]) | (whose[1:] != whose[:-1])]
    first = np.flatnonzero(edge)
    return on & np.repeat(np.diff(np.r_[first, len(on)]) >= RUN, np.diff(np.r_[first, len(on)]))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text -> _SPLIT: hashes, and for each word a byte of its weight and whether it is in a repeated run."""
    tokens = Tokens()
    for batch in batches:
        words, full, weight, number, ends = tokens(batch.column(1).to_pylist())
        marks = (np.minimum(weight, 127) * 2 + repeated_words(full, number, ends)).astype(np.uint8)
        heavy = np.flatnonzero(weight > 127)
        whose = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        more = np.bincount(whose[heavy], weights=(weight - 127)[heavy], minlength=len(ends) - 1).astype(np.int64)
        at, pair = _pairs(words, whose)
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        again = np.bincount(whose[at], weights=count[back.ravel()] >= 3, minlength=len(ends) - 1) / np.maximum(1, np.diff(ends) - 1)
        offsets = ends.astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(words)), pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(marks.tobytes())]), pa.array(more), pa.array(again)],
            names=["doc", "words", "marks", "more", "repeated_share"],
        )


_SPLIT = "doc long, words array<long>, marks binary, more long, repeated_share double"


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, where each list begins, the list of each value)."""
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    return values, ends, np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def _batch(rows: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows.values()], names=list(rows))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lo, hi, forth, back): counts of two neighbours in either order; hi 0: occurrences of a word."""
    for batch in batches:
        words, _, whose = _flat(batch.column(0))
        known, small, count = np.unique(words, return_inverse=True, return_counts=True)
        small = small.ravel().astype(np.int64)
        at = np.flatnonzero((whose[:-1] == whose[1:]) & (words[:-1] > NUMBER) & (words[1:] > NUMBER)) if len(words) > 1 else np.zeros(0, np.int64)
        a, b = small[at], small[at + 1]
        pair, back = np.unique(np.minimum(a, b) * len(known) + np.maximum(a, b), return_inverse=True)
        turned = np.bincount(back.ravel(), weights=a > b, minlength=len(pair)).astype(np.int64)
        times = np.bincount(back.ravel(), minlength=len(pair))
        zero = np.zeros(len(known), np.int64)
        lo, hi = (known[pair // len(known)], known[pair % len(known)]) if len(pair) else (zero[:0], zero[:0])
        yield _batch({"lo": np.r_[lo, known], "hi": np.r_[hi, zero], "forth": np.r_[times - turned, count], "back": np.r_[turned, zero]})


def pair_key(lo: F.Column, hi: F.Column) -> F.Column:
    """One number for a pair, the same as _pair_keys."""
    return F.shiftleft(lo, 21).bitwiseXOR(F.shiftrightunsigned(lo, 43)).bitwiseXOR(hi)


def _pair_keys(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    lo, hi = lo.view(np.uint64), hi.view(np.uint64)
    return ((lo << np.uint64(21)) ^ (lo >> np.uint64(43)) ^ hi).view(np.int64)


def loose_words(counted: DataFrame) -> DataFrame:
    """(key, n, score): occurrences and looseness of every word."""
    pair = counted.filter("hi <> 0")
    same = F.col("lo") == F.col("hi")
    tied = F.when(same, 2 * F.col("forth")).otherwise(2 * F.least("forth", "back"))
    mass = F.when(same, 2 * F.col("forth")).otherwise(F.col("forth") + F.col("back"))
    each = F.when(same, F.array("lo")).otherwise(F.array("lo", "hi"))
    of_word = pair.select(F.explode(each).alias("key"), tied.alias("tied"), mass.alias("mass")).groupBy("key").agg((F.sum("tied") / F.sum("mass")).alias("score"))
    n = counted.filter("hi = 0").select(F.col("lo").alias("key"), F.col("forth").alias("n"))
    return n.join(of_word, "key", "left").filter(F.col("key") > NUMBER).select("key", "n", F.coalesce("score", F.lit(0.0)).alias("score"))


class Table:
    """Sorted keys with their numbers."""

    def __init__(self, key: np.ndarray, *values: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.values = key[order], [v[order] for v in values]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each key."""
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key

    def get(self, key: np.ndarray, whose: np.ndarray, rare: pa.Array | None) -> list[np.ndarray]:
        """The numbers of each key, from the table or from the rare ones of its text; 0 where there are none."""
        at, there = self.find(key)
        out = [np.where(there, v[at], 0.0) if len(v) else np.zeros(len(key)) for v in self.values]
        if rare is not None and rare.null_count < len(rare):
            ends = rare.offsets.to_numpy()  # a null is an empty list here
            held, n, score = (rare.values.field(c).to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for c in ("key", "n", "score"))
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            names, small = np.unique(np.r_[held, key], return_inverse=True)
            small = small.ravel().astype(np.int64)
            own = Table(owner * len(names) + small[: len(held)], n.astype(float), score.astype(float))
            at, there = own.find(whose * len(names) + small[len(held) :])
            out = [np.where(there, v[at] if len(v) else 0.0, o) for o, v in zip(out, own.values)]
        return out


def shipped_and_rare(texts: DataFrame, scores: DataFrame, most: int, keys_of, name: str) -> tuple[DataFrame, Broadcast]:
    """texts (uid, words, ...) with a column ``name`` of the scores (key, n, score) of their rare keys, and a broadcast Table of the others.

    keys_of gives the keys of flat words. Keys with at least total / most occurrences are at most ``most``. A rare key has
    fewer, so none is hot in the join.
    """
    size = scores.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    floor = -(-size["total"] // most) if size["distinct"] > most else 1
    frequent = scores.filter(F.col("n") >= floor).toPandas()  # at most ``most`` rows of three numbers
    shipped = texts.sparkSession.sparkContext.broadcast(Table(frequent["key"].to_numpy(np.int64), frequent["n"].to_numpy(float), frequent["score"].to_numpy(float)))
    kind = "array<struct<key: bigint, n: bigint, score: double>>"
    if floor <= 1:
        return texts.withColumn(name, F.lit(None).cast(kind)), shipped

    def rare_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _, whose = _flat(batch.column(1))
            key, at = keys_of(words, whose)
            missing = ~shipped.value.find(key)[1]
            both = np.unique(np.stack([batch.column(0).to_numpy()[whose[at]][missing], key[missing]], 1), axis=0)
            yield _batch({"uid": both[:, 0], "key": both[:, 1]})

    rare = texts.select("uid", "words").mapInArrow(rare_keys, "uid long, key long").join(scores.filter(F.col("n") < floor), "key")
    lists = rare.groupBy("uid").agg(F.collect_list(F.struct("key", "n", "score")).alias(name))
    return texts.join(lists, "uid", "left"), shipped


def _word_keys(words: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(words > NUMBER)
    return words[at], at


def _neighbour_keys(words: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero((whose[:-1] == whose[1:]) & (words[:-1] > NUMBER) & (words[1:] > NUMBER)) if len(words) > 1 else np.zeros(0, np.int64)
    a, b = words[at], words[at + 1]
    return _pair_keys(np.minimum(a, b), np.maximum(a, b)), at


def _bounds(ends: np.ndarray, whose: np.ndarray, after: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(len(whose))
    return np.maximum(ends[whose], i - SIDE), np.minimum(ends[whose + 1], i + SIDE + after)


def window_means(words: np.ndarray, ends: np.ndarray, whose: np.ndarray, table: Table, rare: pa.Array | None) -> np.ndarray:
    """Mean score of the words around each word: of the frequent ones or of all by their weight, whichever is higher."""
    n, v = table.get(words, whose, rare)
    n, v = np.where(words == URL, 2.0**40, np.where(words == NUMBER, 0.0, n)), np.where(words == URL, 1.0, v)
    low, high = _bounds(ends, whose, 1)

    def mean(weight: np.ndarray) -> np.ndarray:
        cs, ck = np.r_[0, np.cumsum(v * weight)], np.r_[0, np.cumsum(weight)]
        return (cs[high] - cs[low]) / np.maximum(LEAST_KNOWN, ck[high] - ck[low])

    return np.maximum(mean((n >= LEAST_COUNT).astype(float)), mean(n / (n + EVIDENCE)))


def coherent_words(words: np.ndarray, ends: np.ndarray, whose: np.ndarray, total: float, words_of: Table, pairs_of: Table, rare_words, rare_pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the neighbours around each word have a high mean PMI over the swapped order; mean PMI and surplus of each text.

    score of a pair is the share of its occurrences in the order of its hashes. Links have no order; numbers have no pairs.
    The surplus of a pair that is never swapped is the logarithm of its count, so it would grow with the corpus: counts
    are taken as so many of PAIRS_OF_GAIN neighbour pairs where there are more, and as one at least.
    """
    key, at = _neighbour_keys(words, whose)
    n, share = pairs_of.get(key, whose[at], rare_pairs)
    share = np.where(words[at] <= words[at + 1], share, 1 - share)
    same = words[at] == words[at + 1]
    forth, back = np.round(n * share), np.round(np.where(same, n, n * (1 - share)))
    gain, weight = np.zeros(len(words)), np.zeros(len(words))
    seen = np.minimum(n, np.maximum(n * min(1.0, PAIRS_OF_GAIN / max(total, 1.0)), 1.0))
    part = seen / np.maximum(n, 1.0)
    gain[at], weight[at] = np.log2((forth * part + 0.5) / (back * part + 0.5)), seen / (seen + PAIR_EVIDENCE)
    link = np.flatnonzero((whose[:-1] == whose[1:]) & ((words[:-1] == URL) | (words[1:] == URL))) if len(words) > 1 else np.zeros(0, np.int64)
    weight[link] = 1.0
    low, high = _bounds(ends, whose, 0)
    high = np.maximum(low, high)
    cs, ck = np.r_[0, np.cumsum(gain * weight)], np.r_[0, np.cumsum(weight)]
    known = ck[high] - ck[low]
    coherent = (known >= 1) & ((cs[high] - cs[low]) >= GAIN * known)
    each = words_of.get(words, whose, rare_words)[0]
    pmi = np.log2(np.maximum(forth, 1) * total / np.maximum(each[at] * each[at + 1], 1))
    texts = len(ends) - 1
    some = np.maximum(1, np.bincount(whose[at], minlength=texts))
    return coherent, np.bincount(whose[at], weights=pmi, minlength=texts) / some, np.bincount(whose[at], weights=gain[at], minlength=texts) / some


_RATED = "doc long, n_words int, keyword_share double, repeated_share double, mean_pmi double, pmi_gain double, is_keyword_page boolean"


def keyword_share(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, keyword_share, repeated_share, mean_pmi, pmi_gain, is_keyword_page) of every document that has words.

    keyword_share is the share of words in windows of high affinity that aren't coherent, or in runs of collocations that
    are repeated excessively; repeated_share the share of neighbour pairs that the document has three times or more;
    mean_pmi the mean PMI of its neighbours in bits, pmi_gain by how much it is above that of the swapped order (0 without
    pairs). A document is a keyword page if keyword_share is above one half. Null, blank and wordless texts have no row;
    copies get a row each; whole texts are read. Other columns don't matter.
    """
    plain = docs.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    split = plain.mapInArrow(_split, _SPLIT).filter(F.size("words") > 0).withColumn("uid", F.monotonically_increasing_id())
    texts = materialize(split, "words")  # from here on uid is a stored number
    counted = texts.select("words").mapInArrow(_neighbours, "lo long, hi long, forth long, back long").groupBy("lo", "hi").agg(F.sum("forth").alias("forth"), F.sum("back").alias("back"))
    counted = materialize(counted, "neighbours")
    words = materialize(loose_words(counted), "loose")
    scored, loose = shipped_and_rare(texts.select("uid", "words"), words, MAX_WORDS, _word_keys, "rare")

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends, whose = _flat(batch.column(0))
            held, count = np.unique(flat[(window_means(flat, ends, whose, loose.value, batch.column(1)) >= LOOSE) & (flat > NUMBER)], return_counts=True)
            yield _batch({"key": held, "held": count})

    held = scored.select("words", "rare").mapInArrow(among, "key long, held long").groupBy("key").agg(F.sum("held").alias("held"))
    affine = materialize(words.join(held, "key", "left").select("key", "n", (F.coalesce("held", F.lit(0)) / F.col("n")).alias("score")), "affinity")
    pairs = counted.filter("hi <> 0").select(pair_key(F.col("lo"), F.col("hi")).alias("key"), (F.col("forth") + F.col("back")).alias("n"), F.col("forth").alias("f"))
    pairs = materialize(pairs.groupBy("key").agg(F.sum("n").alias("n"), (F.sum("f") / F.sum("n")).alias("score")), "pairs")
    total = float(pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    scored, affinity = shipped_and_rare(texts, affine, MAX_WORDS, _word_keys, "rare")
    scored, pair_scores = shipped_and_rare(scored, pairs, MAX_PAIRS, _neighbour_keys, "rare_pairs")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends, whose = _flat(batch.column(1))
            marks = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8)
            weight, repeated, n = (marks >> 1).astype(float), (marks & 1) > 0, len(ends) - 1
            coherent, pmi, gain = coherent_words(flat, ends, whose, total, affinity.value, pair_scores.value, batch.column(5), batch.column(6))
            keyword = (window_means(flat, ends, whose, affinity.value, batch.column(5)) >= AFFINE) & ~coherent | repeated
            more = batch.column(3).to_numpy().astype(float)  # of runs of more than 254 Chinese characters
            every = np.bincount(whose, weights=weight, minlength=n) + more
            on = np.bincount(whose, weights=weight * keyword, minlength=n)
            long = np.bincount(whose, weights=keyword & (weight == 127), minlength=n) / np.maximum(1, np.bincount(whose, weights=weight == 127, minlength=n))
            share = (on + more * long) / every
            yield _batch({"doc": batch.column(0), "n_words": np.diff(ends).astype(np.int32), "keyword_share": share, "repeated_share": batch.column(4), "mean_pmi": pmi, "pmi_gain": gain, "is_keyword_page": share > MOST})

    rated = scored.select("doc", "words", "marks", "more", "repeated_share", "rare", "rare_pairs").mapInArrow(rate, _RATED)
    return rated.withColumnRenamed("doc", doc_id)
