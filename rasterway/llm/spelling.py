"""Spelling variants: frequent words, their neighbours at one edit, forms and roots.

Words that differ by one code point agree on everything outside some segment of
positions.  Rows of a word go to the groups of both halves of its positions (the key is
what lies outside the half); a group that many words share is split into the two halves
of its segment, again and again, until it is small or its segment is one position, where
an alphabet bounds it.  So every near pair meets in exactly one group, no group grows
with the vocabulary, and nothing is compared pair by pair.

In a group, words have a place in forward order and one in the order of their reversed
strings.  For every edit position the words that share what stands before it are an
interval of the forward order, those that share what stands behind it one of the reverse
order; a wavelet tree over the reverse places in forward order reports the words in both.

Defined results: null and empty texts have no words; a null id writes nothing before the
colon of its hash; repeated rows count each; words of any length are taken whole; of
near words with equal counts the smallest in code-point order is the form; an empty table
gives no row; columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterway.llm import shared as S

#: Runs of letters in a text whose A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: One of so many occurrences has a code point deleted.
SLIPS = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Distinct words that a task counts before it passes them on.
HELD = 300_000
#: Words of a group before its segment is split, and rows of one bucket of groups.
GROUP, BUCKET = 20_000, 60_000


def _slipped(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count(batches):
    """(word, n) of every batch of doc_id and text, for words of LEAST_LENGTH or more."""
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            if not (text := text.as_py()):
                continue
            doc = doc.as_py()
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                h = zlib.crc32(word.encode(), start)
                if h % SLIPS == 0:
                    word = _slipped(word, h)
                if len(word) >= LEAST_LENGTH:
                    held[word] += n
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: all words that occur ``least`` times or more."""
    found = docs.select("doc_id", "text").mapInArrow(_count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Wavelet:
    """Which values, all distinct, stand in a range of places and lie in a range of values."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, left, right, low, high) -> tuple[np.ndarray, np.ndarray]:
        """(number of the query, value) of all values in places [left, right) and in [low, high)."""
        query, base = np.arange(len(left)), np.zeros(len(left), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            l0, r0 = zeros[left], zeros[right]
            total = zeros[-1]
            query, base = np.concatenate([query, query]), np.concatenate([base, base + (1 << b)])
            left, right = np.concatenate([l0, left - l0 + total]), np.concatenate([r0, right - r0 + total])
            on = np.flatnonzero((left < right) & (base < high[query]) & (base + (1 << b) > low[query]))
            query, base, left, right = query[on], base[on], left[on], right[on]
        return query, base


def _runs(codes: np.ndarray, least: int, most: int):
    """For each length p from ``least`` to ``most``: [start, stop) of the rows of sorted ``codes`` that share p columns with each row."""
    n = len(codes)
    new = np.zeros(n, bool)
    new[0] = True
    new[1:] = (codes[1:, :least] != codes[:-1, :least]).any(1)
    for p in range(least, most + 1):
        if p > least:
            new[1:] |= codes[1:, p - 1] != codes[:-1, p - 1]
        head = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        yield p, head[run], np.append(head[1:], n)[run]


def _order(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, code points in that order)."""
    a = np.array(words, f"<U{width}")
    order = np.argsort(a, kind="stable")
    return order, a[order].view("<u4").reshape(len(a), width)


def near_words(words: list[str], length: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a, b) of distinct ``words``: a of ``length`` points, b with one of a's points [lo, hi) replaced or one more before such a point.

    Words have ``length`` points or one more.  The end of a word counts as a point of its
    last segment.  Of the places where an insertion gives one result the first is taken.
    """
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    forward, f_codes = _order(words, length + 1)
    reverse, r_codes = _order([w[::-1] for w in words], length + 1)
    at_f, at_r = np.empty(n, np.int64), np.empty(n, np.int64)
    at_f[forward], at_r[reverse] = np.arange(n), np.arange(n)
    f_runs = {p: (a, b) for p, a, b in _runs(f_codes, lo, hi)}
    r_runs = {p: (a, b) for p, a, b in _runs(r_codes, max(length - hi - 1, 0), length - lo)}
    short = np.flatnonzero(sizes == length)
    sf, sr = at_f[short], at_r[short]
    found = []
    for more in (0, 1):
        target = sizes == length + more
        if not target.any():
            continue
        up_f, up_r = (np.concatenate([[0], np.cumsum(target[o])]) for o in (forward, reverse))
        in_forward, in_reverse = forward[target[forward]], reverse[target[reverse]]
        tree = Wavelet(up_r[at_r[in_forward]])
        for at in range(lo, hi + (more and hi == length)):
            left, right = (up_f[x[sf]] for x in f_runs[at])
            low, high = (up_r[x[sr]] for x in r_runs[length - at - 1 + more])
            # Without an insertion each word reports itself, too.
            some = np.flatnonzero((right - left > 1 - more) & (high - low > 1 - more))
            query, value = tree.report(left[some], right[some], low[some], high[some])
            a, b = short[some[query]], in_reverse[value]
            if more and at:
                keep = f_codes[at_f[a], at - 1] != f_codes[at_f[b], at]
            else:
                keep = a != b
            found.append((a[keep], b[keep]))
            if more:
                found.append((b[keep], a[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _near_in_bucket(table: pa.Table) -> pa.Table:
    """(word, near, near_n) of all pairs that the groups of a bucket hold."""
    table = table.combine_chunks()
    size, lo, hi = (table.column(c).to_numpy() for c in ("size", "lo", "hi"))
    kind = (size * 4096 + lo) * 4096 + hi if size.max() < 4096 else np.unique(np.stack([size, lo, hi]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(kind, kind="stable")
    left, right = [], []
    for part in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        if len(part) > 1:
            a, b = near_words(table.column("word").take(pa.array(part)).to_pylist(), int(size[part[0]]), int(lo[part[0]]), int(hi[part[0]]))
            left.append(part[a])
            right.append(part[b])
    a, b = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (left, right))
    return pa.table({"word": table.column("word").take(a), "near": table.column("word").take(b), "near_n": table.column("n").take(b)})


def _outside(lo: Column, hi: Column, longer: Column) -> Column:
    """What of a word lies outside the points [lo, hi), of which a longer word has one more."""
    return F.concat(F.substring("word", F.lit(1), lo), F.lit("|"), F.substring("word", hi + longer + 1, F.length("word")))


def _halves(lo: Column, hi: Column) -> Column:
    mid = lo + F.floor((hi - lo) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))


def _split(rows: DataFrame) -> DataFrame:
    """Rows of word, n, longer, size, lo, hi in the groups of both halves of their segments."""
    parts = rows.withColumn("part", F.explode(_halves(F.col("lo"), F.col("hi")))).select("word", "n", "longer", "size", "part.lo", "part.hi")
    return parts.withColumn("key", F.xxhash64("size", "lo", "hi", _outside(F.col("lo"), F.col("hi"), F.col("longer"))))


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, near, near_n: both directions of every pair of ``words`` at one edit, each once."""
    roles = words.where("length(word) > 0").withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).where("longer = 0 OR length(word) > 1")
    level = _split(roles.select("*", (F.length("word") - F.col("longer")).alias("size"), F.lit(0).alias("lo"), (F.length("word") - F.col("longer")).alias("hi")))
    done = []
    while True:
        level = S.written(level)
        large = S.written(level.groupBy("key").count().where(F.col("count") > group))
        if large.isEmpty():
            done.append(level)
            break
        hot = (F.col("count").isNotNull()) & (F.col("hi") - F.col("lo") > 1)
        level = level.join(large, "key", "left")
        done.append(S.written(level.where(~hot).drop("count")))
        level = _split(level.where(hot).drop("count"))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    n = max(S.LEAST_GROUPS, -(-rows.count() // BUCKET))
    dealt = rows.select(F.pmod("key", F.lit(n)).cast("int").alias("bucket"), "word", "n", "size", "lo", "hi")
    return dealt.groupBy("bucket").applyInArrow(lambda t: _near_in_bucket(t), "word string, near string, near_n long")


def _roots(links: DataFrame) -> DataFrame:
    """word, root for every word with a form: the last of its forms.

    Each round doubles the steps taken; forms at least double their counts, so chains are short.
    """
    found = S.written(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = S.written(found.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if found.where("moved").isEmpty():
            return found.select("word", "root")
        found = found.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word that occurs ``least`` times or more."""
    words = S.written(vocabulary(docs, least))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    fits = -F.col("best.n") >= 2 * F.col("n")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n"))
    known = S.written(known)
    rooted = known.join(_roots(known.where("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
