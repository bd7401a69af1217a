"""Toxicity: subword bags averaged into a linear softmax, trained jointly in numpy.

The bag is a window of WINDOW words: the embeddings of the character n-grams of a word (hashed to BUCKETS rows) are
averaged to the word, the words of the window are averaged to the bag, and a linear softmax over that mean gives its
class.  All windows of a text are bags, and the text is as toxic as its worst one, so that a long text doesn't
dilute a short insult and a phrase counts as a whole.  Embeddings and softmax are learnt together by Adam,
through the same windows.  Misspellings and inflections never seen in training share n-grams with words that
were.  Training takes a bounded sample of labelled rows (SAMPLE of each class, of MOST_CHARS each); scoring is one narrow
pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most labelled documents of each class that training reads, and the longest of them in characters: the documented bound of the sample.
SAMPLE, MOST_CHARS = 900, 150_000
#: Characters of a class in all; the sample ends before it would have more.
MOST_TOTAL = 12_000_000
BUCKETS, DIMENSIONS = 1 << 17, 8
NGRAMS = (3, 4, 5)
#: Words in a bag.
WINDOW = 4
STEPS, RATE, DECAY = 150, 0.05, 1e-4
#: An n-gram is learnt when so many training documents hold it; of fewer than 25 times as many documents the 25th part is enough, two at least.
LEAST_DOCUMENTS = 12
#: Characters that a task hashes at once.
SLICE = 1_000_000
#: Base and multiplier of the n-grams' polynomial hash.
BASE, MIX = np.uint64(1_099_511_628_211), np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The words of a text, lower-cased; a text without words is one empty word."""
    return (text or "").lower().split() or [""]


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the word, bucket) of the words themselves and of their n-grams, with ends marked: one pair of arrays for each length."""
    codes = np.frombuffer("".join(f"<{w}> " for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    ends = np.flatnonzero(codes == 32)  # words hold no space
    starts = np.concatenate(([0], ends[:-1] + 1))
    owner = np.repeat(np.arange(len(words)), ends - starts + 1)
    left = ends[owner] - np.arange(len(codes))  # characters to the end of the word; 0 at the gap
    bucket = lambda h: ((h * MIX) >> np.uint64(64 - 17)).astype("int64")
    powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(int((ends - starts).max()), BASE))))
    inside = np.where(left > 0, codes * powers[np.maximum(left - 1, 0)], np.uint64(0))
    yield np.arange(len(words)), bucket(np.add.reduceat(inside, starts))
    h = codes
    for n in range(2, max(NGRAMS) + 1):
        if len(codes) < n:
            return
        h = h[:-1] * BASE + codes[n - 1 :]
        if n in NGRAMS:
            own = np.flatnonzero(left[: len(h)] >= n)
            yield owner[own], bucket(h[own])


class Bags:
    """Texts as arrays: the words of each in order, by number; the n-grams of each different word; the windows."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        documents = [[number.setdefault(w, len(number)) for w in words_of(text)] for text in texts]
        sizes = np.array([len(d) for d in documents])
        self.tokens = np.fromiter((w for d in documents for w in d), "int64", int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        n_windows = np.maximum(1, sizes - WINDOW + 1)
        self.document = np.repeat(np.arange(len(texts)), n_windows)
        self.starts = np.cumsum(n_windows) - n_windows
        self.low = first[self.document] + np.arange(len(self.document)) - self.starts[self.document]
        self.width = np.minimum(WINDOW, sizes)[self.document]
        found = list(grams(list(number)))
        word, gram = np.concatenate([w for w, _ in found]), np.concatenate([g for _, g in found])
        self.n_words, self.sizes = len(number), np.bincount(word, minlength=len(number))
        # Only n-grams of several documents are learnt: one of a single document could only memorise its label.
        order = np.argsort(word, kind="stable")
        word, gram = word[order], gram[order]
        cuts = np.concatenate(([0], np.cumsum(self.sizes)))
        held = np.zeros(BUCKETS, dtype="int64")
        for d in documents:
            held[np.unique(np.concatenate([gram[cuts[w] : cuts[w + 1]] for w in set(d)]))] += 1
        self.learnt = np.flatnonzero(held >= min(LEAST_DOCUMENTS, max(2, len(documents) // 25)))
        row = np.full(BUCKETS, -1, dtype="int64")
        row[self.learnt] = np.arange(len(self.learnt))
        kept = row[gram] >= 0
        self.grams, self.gram_words = row[gram[kept]], word[kept]


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights by bucket and bias: what embeddings and softmax amount to for the difference of the two classes.

    As everything up to the logits is linear, sums over n-grams are taken of their weights and slopes, not of their vectors.
    """
    bags = Bags(texts)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (len(bags.learnt), DIMENSIONS))
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, softmax, bias)]
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    for step in range(steps):
        turn = softmax[:, 1] - softmax[:, 0]
        word = np.bincount(bags.gram_words, weights=(table @ turn)[bags.grams], minlength=bags.n_words) / bags.sizes
        total = np.concatenate(([0.0], np.cumsum(word[bags.tokens])))
        z = (total[bags.low + bags.width] - total[bags.low]) / bags.width + bias[1] - bias[0]
        # The worst window decides, first softly and then more sharply.
        sharp = min(1.0, step / (steps * 0.6)) * 8
        weight = np.exp(sharp * (z - np.maximum.reduceat(z, bags.starts)[bags.document]))
        weight /= np.add.reduceat(weight, bags.starts)[bags.document]
        score = np.clip(np.add.reduceat(weight * z, bags.starts), -30, 30)
        slope = ((1 / (1 + np.exp(-score)) - labels) * share)[bags.document] * weight
        # Back through the windows to words, and through words to n-grams.
        each = slope / bags.width
        edges = np.bincount(bags.low, weights=each, minlength=len(bags.tokens) + 1) - np.bincount(bags.low + bags.width, weights=each, minlength=len(bags.tokens) + 1)
        d_word = np.bincount(bags.tokens, weights=np.cumsum(edges)[:-1], minlength=bags.n_words) / bags.sizes
        d_gram = np.bincount(bags.grams, weights=d_word[bags.gram_words], minlength=len(table))
        d_turn = table.T @ d_gram
        gradients = (np.outer(d_gram, turn) + DECAY * table, np.stack([-d_turn, d_turn], axis=1), np.array([-slope.sum(), slope.sum()]))
        for parameter, gradient, (first, second) in zip((table, softmax, bias), gradients, moments):
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient**2 - second)
            parameter -= RATE * (first / (1 - 0.9 ** (step + 1))) / (np.sqrt(second / (1 - 0.99 ** (step + 1))) + 1e-8)
    weights = np.zeros(BUCKETS, dtype="float32")
    weights[bags.learnt] = table @ (softmax[:, 1] - softmax[:, 0])
    return weights, float(bias[1] - bias[0])


def word_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean weight of the n-grams of each word, hashed in slices of SLICE characters or one word."""
    out, at = [], 0
    while at < len(words):
        end, chars = at, 0
        while end < len(words) and (end == at or chars + len(words[end]) < SLICE):
            chars += len(words[end]) + 3
            end += 1
        total, count = np.zeros(end - at), np.zeros(end - at)
        for owner, bucket in grams(words[at:end]):
            total += np.bincount(owner, weights=weights[bucket], minlength=end - at)
            count += np.bincount(owner, minlength=end - at)
        out.append(total / count)
        at = end
    return np.concatenate(out)


def worst_windows(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """Score of each text: the softmax of its worst window."""
    split = [words_of(t) for t in texts]
    sizes = [len(s) for s in split]
    known = list(dict.fromkeys(w for s in split for w in s))
    value = dict(zip(known, word_scores(known, weights).tolist()))
    total = np.concatenate(([0.0], np.cumsum(np.fromiter((value[w] for s in split for w in s), "float64", sum(sizes)))))
    out, at = np.empty(len(texts)), 0
    for k, n in enumerate(sizes):
        own, width = total[at : at + n + 1], min(WINDOW, n)
        out[k] = (own[width:] - own[:-width]).max() / width
        at += n
    return 1 / (1 + np.exp(-np.clip(out + bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on at most ``sample`` labelled rows of each class, chosen by a hash of the id, none of them held out nor longer than MOST_CHARS,
    and of MOST_TOTAL characters together.

    Without any labelled row the model is empty: weights 0 and a bias that scores below one half.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    chosen = None
    for value in (0, 1):
        own = usable.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= MOST_CHARS)
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    so_far = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))  # over the sample alone
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= MOST_TOTAL).orderBy("id").collect()
    if not rows:
        return np.zeros(BUCKETS, dtype="float32"), -4.0
    return train([r["text"] for r in rows], np.array([r["label"] for r in rows]))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that never lend their label: crc32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Only the text is scored; null counts as empty, and an empty text gets the score of one empty word.
    Repeated rows score alike, a null id counts as held out, an empty table gives an empty result (and a
    label table without rows a model that predicts 0).  Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out, part, chars = [], [], 0
        for text in texts:  # long texts don't share a slice
            if part and chars + len(text or "") > SLICE:
                out.append(worst_windows(part, *model.value))
                part, chars = [], 0
            part.append(text)
            chars += len(text or "")
        return pd.Series(np.concatenate([*out, worst_windows(part, *model.value)]) if part else [], dtype="float64")

    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
