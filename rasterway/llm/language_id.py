"""Language identification by unigram pieces summed over all segmentations.

Words are runs of letters with their combining marks (vowel signs, points, accents),
composed where Unicode has one character for both, lower-cased, with the vocabulary's word
mark before them.  Marks alone are no word, and the dot that lower-casing parts from İ is none.
Its pieces carry that mark at their start only, so no piece crosses words
and the sum over all segmentations of a text is the product of its words' sums.

1. Training counts the words of each language over all training documents; word
   counts, not texts, are shuffled.
2. Expectation maximisation: a forward and a backward pass over every counted word
   share its occurrences among the pieces of all its segmentations, and the pieces'
   expected counts become the next probabilities.
3. A document's words are scored by the forward pass under each language.  The model
   has a row for each piece of the fixed vocabulary and a column for each
   language; words recur, so a worker scores each only once.

The passes run over the lattices of many words at once, for all languages, place by
place; sums are rescaled on the way, so words of any length count with all their
segmentations.

Defined results: a null text or one without letters (numbers such as ² or ½ are none) is
``und`` with score 0; null languages teach nothing; if nothing can be learned all rows are
``und``; repeated rows are counted and scored each; ties go to the first language by name;
an empty table gives no row; columns named lang_pred and score are replaced, all others
pass through.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterway.llm import shared as S

MARK = "▁"
#: Rounds of expectation maximisation.
ROUNDS = 2
#: Added to each piece's expected count, so that none is impossible.
SMOOTHING = 0.01
#: Documents whose words are looked up at once.
ROWS = 512
#: Words a worker remembers.
CACHE = 120_000
#: Log-likelihoods count this much, since neighbouring words are not independent.
TEMPER = 0.5

#: Characters of words whose lattices are built at once (one word at least).
CHARS = 1 << 18
#: Letters of words whose sums need no scale.
SHORT = 16
#: Places after which the sums of longer words are scaled anew.
STEP = 8


#: What lower-casing leaves of İ beside an i.
DOT = "\u0307"
#: ASCII bytes other than letters become spaces.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Pieces of the fixed public vocabulary that lie within a word, and their rows."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return {p: i for i, p in enumerate(p for p in pieces if MARK not in p[1:] and p.lower() == p)}


def words_of(text: str) -> list[str]:
    """The runs of letters, with their marks, of the lower-cased text."""
    text = text.lower()
    if text.isascii():
        return text.encode().translate(_LETTERS).decode().split()
    text, marks = unicodedata.normalize("NFC", text), False
    for c in set(text):
        if c > "\x7f" and not c.isalpha():
            if unicodedata.category(c)[0] == "M" and c != DOT:
                marks = True
            else:
                text = text.replace(c, " ")
    words = text.encode().translate(_LETTERS).decode().split()
    return [w for w in words if w.isascii() or any(map(str.isalpha, w))] if marks else words


class Lattice:
    """The vocabulary as a trie in arrays; a character that it lacks is a piece of its own."""

    def __init__(self, rows: dict[str, int]):
        self.rows, self.other = rows, len(rows)
        self.deepest = max(map(len, rows), default=1)
        letters = sorted({c for p in rows for c in p})
        #: By code point, the number of a letter of the vocabulary, or 0.
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        number = {c: k for k, c in enumerate(letters, 1)}
        steps: dict[int, int] = {}
        row = [-1]
        for p, r in rows.items():
            state = 0
            for c in p:
                step = state * self.width + number[c]
                if step not in steps:
                    steps[step] = len(row)
                    row.append(-1)
                state = steps[step]
            row[state] = r
        self.steps = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.steps.tolist()], np.int64)
        #: The piece that ends in a state, or -1.
        self.row = np.array(row, np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which go on, their states)."""
        if not len(self.steps):
            return np.zeros(len(state), bool), state[:0]
        want = state * self.width + code
        at = np.minimum(np.searchsorted(self.steps, want), len(self.steps) - 1)
        on = self.steps[at] == want
        return on, self.next[at[on]]


class Edges:
    """The lattices of many words: every piece at every place, grouped for passes over all words at once.

    Words are numbered by falling length (``order`` gives their places in the list).  Sums
    are kept as values and the logarithm of their scale, so that words of any length
    neither vanish nor lose segmentations.
    """

    def __init__(self, lattice: Lattice, words: list[str]):
        length = np.fromiter(map(len, words), np.int64, len(words))
        self.order = np.argsort(-length, kind="stable")
        self.length = length[self.order]
        self.short = not len(words) or self.length[0] <= SHORT
        self.deepest = lattice.deepest
        codes = lattice.code[np.frombuffer("".join([words[k] for k in self.order.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        first = np.cumsum(self.length) - self.length
        word = np.repeat(np.arange(len(words)), self.length)
        #: Sums have a place more than a word has letters: where each word's begin.
        self.base = first + np.arange(len(words))
        place = np.arange(len(codes)) - first[word]
        found = []
        at, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for depth in range(1, lattice.deepest + 1):
            on, state = lattice.step(state, codes[at + depth - 1])
            row = np.full(len(at), lattice.other if depth == 1 else -1, np.int64)
            row[on] = np.where(lattice.row[state] >= 0, lattice.row[state], row[on])
            real = row >= 0
            found.append((at[real], np.full(int(real.sum()), depth), row[real]))
            at = at[on]
            more = place[at] + depth < self.length[word[at]]
            at, state = at[more], state[more]
            if not len(at):
                break
        at, depth, self.row = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        key = place[at] * (lattice.deepest + 1) + depth
        by = np.argsort(key, kind="stable")
        at, depth, self.row = at[by], depth[by], self.row[by]
        self.word = word[at]
        self.begin = self.base[self.word] + place[at]
        self.end = self.begin + depth
        key = key[by]
        cuts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
        #: (place, first edge, end) of every group: in one no two edges share a word.
        self.groups = [(int(key[a] // (lattice.deepest + 1)), int(a), int(b)) for a, b in zip(cuts, cuts[1:])]

    def _scaled(self, sums: np.ndarray, scale: np.ndarray, k: int) -> None:
        """Divides the sums from place ``k`` on, as far as pieces reach, by their largest in each word."""
        many = int(np.searchsorted(-self.length, -k, side="right"))  # words of k letters or more
        base, length = self.base[:many, None], self.length[:many, None]
        near = k + np.arange(self.deepest + 1)
        inside = near <= length
        at = base + np.minimum(near, length)
        window = np.where(inside[..., None], sums[at], 0)
        top = window.max(1)
        top[top <= 0] = 1
        own = np.broadcast_to(np.log(top)[:, None], window.shape)
        sums[at[inside]] = (window / top[:, None])[inside]
        scale[at[inside]] += own[inside]

    def forward(self, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums over all segmentations up to each place, logarithms of their scales); ``prob`` by edge and language."""
        sums = np.zeros((int(self.base[-1] + self.length[-1]) + 1 if len(self.base) else 0, prob.shape[1]))
        scale = np.zeros_like(sums)
        sums[self.base] = 1
        if self.short:
            for _, a, b in self.groups:
                sums[self.end[a:b]] += sums[self.begin[a:b]] * prob[a:b]
            return sums, scale
        last = 0
        for k, a, b in self.groups:
            if k != last:
                last = k
                if k % STEP == 0:
                    self._scaled(sums, scale, k)
            at, to = self.begin[a:b], self.end[a:b]
            new = sums[to] == 0
            scale[to] = np.where(new, scale[at], scale[to])
            sums[to] += sums[at] * prob[a:b] * np.exp(scale[at] - scale[to])
        return sums, scale

    def backward(self, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros((int(self.base[-1] + self.length[-1]) + 1 if len(self.base) else 0, prob.shape[1]))
        scale = np.zeros_like(sums)
        sums[self.base + self.length] = 1
        if self.short:
            for _, a, b in reversed(self.groups):
                sums[self.begin[a:b]] += sums[self.end[a:b]] * prob[a:b]
            return sums, scale
        last = None
        for k, a, b in reversed(self.groups):
            if k != last:
                last = k
                if k % STEP == 0:
                    self._scaled(sums, scale, k + 1)
            to, at = self.begin[a:b], self.end[a:b]
            new = sums[to] == 0
            scale[to] = np.where(new, scale[at], scale[to])
            sums[to] += sums[at] * prob[a:b] * np.exp(scale[at] - scale[to])
        return sums, scale

    def likelihoods(self, prob: np.ndarray) -> np.ndarray:
        """(words, languages) log-likelihoods, in the order of the list."""
        sums, scale = self.forward(prob[self.row])
        last = self.base + self.length
        out = np.empty((len(self.base), prob.shape[1]))
        out[self.order] = np.log(np.maximum(sums[last], 1e-300)) + scale[last]
        return out


def parts_of(words: list[str]):
    """Places of ``words`` in lists of about CHARS letters, short and long words apart."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    for some in (np.flatnonzero(length <= SHORT), np.flatnonzero(length > SHORT)):
        part = np.cumsum(length[some]) // CHARS
        yield from np.split(some, np.flatnonzero(np.diff(part)) + 1) if len(some) else []


class Model:
    def __init__(self, languages: list[str], rows: dict[str, int], prob: np.ndarray):
        self.languages, self.prob = languages, prob
        self.lattice = Lattice(rows)
        #: Rows of log-likelihoods that words have: of those lately used, and of those before.
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.known, self.former = np.zeros((2, CACHE, len(languages)))

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of ``words`` under each language."""
        own = [MARK + w for w in words]
        out = np.zeros((len(own), len(self.languages)))
        for part in parts_of(own):
            out[part] = Edges(self.lattice, [own[k] for k in part.tolist()]).likelihoods(self.prob)
        return out

    def _rows(self, words: list[str]) -> list[int]:
        """The rows of ``known`` of all ``words``."""
        new = set(words).difference(self.young)
        if new and len(self.young) + len(new) > CACHE:
            self.old, self.young, self.known, self.former = self.young, {}, self.former, self.known
            new = set(words)
        if new:
            first, end = len(self.young), len(self.young) + len(new)
            if end > len(self.known):
                self.known = np.zeros((end, len(self.languages)))
            again = [w for w in new if w in self.old]
            fresh = [w for w in new if w not in self.old]
            self.known[first : first + len(again)] = self.former[[self.old[w] for w in again]]
            self.known[first + len(again) : end] = self.words(fresh)
            self.young.update(zip(again + fresh, range(first, end)))
        return list(map(self.young.__getitem__, words))

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(languages, their posteriors); a text's words weigh in by their numbers."""
        by_text = [words_of(t) if t else [] for t in texts]
        size = np.fromiter(map(len, by_text), np.int64, len(texts))
        flat = [w for words in by_text for w in words]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not flat or not self.languages:
            return names, scores
        some = np.flatnonzero(size)
        rows = self._rows(flat)
        total = np.add.reduceat(self.known[rows], (np.cumsum(size) - size)[some])
        best = total.argmax(1)
        scores[some] = 1 / np.exp(np.minimum(0, TEMPER * (total - total.max(1, keepdims=True)))).sum(1)
        for k, b in zip(some.tolist(), best.tolist()):
            names[k] = self.languages[b]
        return names, scores


def _word_counts(batches):
    """Words of each language, summed up batch by batch."""
    for batch in batches:
        counts: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text or ""))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        lang, word, n = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def _expected(rows: dict[str, int], codes: dict[str, int], prob):
    """Word counts to the pieces' expected counts under ``prob``."""

    def run(batches):
        lattice, p = _lattice(rows), prob.value
        total = np.zeros(p.size)
        for batch in batches:
            words = [MARK + w for w in batch.column("word").to_pylist()]
            lang = np.array([codes[x] for x in batch.column("lang").to_pylist()], np.int64)
            n = batch.column("n").to_numpy()
            for part in parts_of(words):
                edges = Edges(lattice, [words[k] for k in part.tolist()])
                word = part[edges.order][edges.word]
                cell = edges.row * p.shape[1] + lang[word]
                own = p.ravel()[cell][:, None]
                alpha, up = edges.forward(own)
                beta, down = edges.backward(own)
                last = edges.base + edges.length
                whole = (np.log(np.maximum(alpha[last], 1e-300)) + up[last])[edges.word, 0]
                inside = alpha[edges.begin, 0] * own[:, 0] * beta[edges.end, 0]
                share = inside * np.exp(up[edges.begin, 0] + down[edges.end, 0] - whole)
                total += np.bincount(cell, share * n[word], p.size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // p.shape[1]).astype(np.int32)), pa.array((at % p.shape[1]).astype(np.int32)), pa.array(total[at])], ["r", "k", "n"])

    return run


def _lattice(rows: dict[str, int]) -> Lattice:
    return S.kept(("lattice", len(rows), hash(tuple(rows))), lambda: Lattice(rows))


def fit(training: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> Model:
    """A model of the languages in ``training`` (text, lang).

    What comes to the driver has a row for each vocabulary piece and language.
    """
    spark, rows = training.sparkSession, vocabulary(path)
    counts = training.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(_word_counts, "lang string, word string, n long")
    counts = S.written(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    codes = {lang: i for i, lang in enumerate(languages)}
    prob = np.full((len(rows) + 1, len(languages)), 1 / (len(rows) + 1))
    # Longer pieces start likelier, as if their characters were drawn one by one.
    for piece, i in rows.items():
        prob[i] *= math.exp(len(piece))
    prob /= np.maximum(prob.sum(0), 1e-300)
    for _ in range(rounds):
        found = counts.mapInArrow(_expected(rows, codes, spark.sparkContext.broadcast(prob)), "r int, k int, n double")
        table = found.groupBy("r", "k").agg(F.sum("n").alias("n")).toArrow()
        total = np.full(prob.shape, SMOOTHING)
        total[table["r"].to_numpy(), table["k"].to_numpy()] += table["n"].to_numpy()
        prob = total / total.sum(0)
    return Model(languages, rows, prob)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    name = uuid.uuid4().hex
    state = docs.sparkSession.sparkContext.broadcast((model.languages, model.lattice.rows, model.prob))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double"])

    def run(batches):
        own = S.kept(("languages", name), lambda: Model(*state.value))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                names, scores = own.texts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(share: int = 3, left: int = 1):
    """Rows set aside: crc32(doc_id as text) modulo ``share`` is ``left``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % share == left


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with lang_pred and score, learned from the rows that are not set aside."""
    return predict(docs, fit(docs.where(~held_out())))
