"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (plus one share per unknown
character). The likelihood of a word is the sum over all its segmentations into pieces, computed by a
forward algorithm; a text's likelihood is the product over its words. Piece probabilities are learned by
expectation maximisation with the same forward sums and their backward counterpart, on a bounded sample of
labelled rows. The predicted language has the highest posterior under equal priors; the score is that
posterior with each text's evidence divided by the square root of its word count, so long texts don't all
end at 1.

Words are maximal runs of letters in lower case. A text that is null or has no letter gets ``und`` and
score 0. Rows without a label are never learned from; without any labelled row every text gets ``und``.
Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from array import array
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votesel.llm.common import tokenizer_path

LETTERS = regex.compile(r"\p{L}+")
START = "▁"
UNKNOWN = "und"
#: Longest word whose sums fit a double as they are; those of longer runs of letters are rescaled on the way.
MAX_WORD = 40


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def public_pieces(path: str) -> list[str]:
    """Letter pieces of the vocabulary file, lower case, with their word-start mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = {p.lower() for p in map(sp.id_to_piece, range(sp.get_piece_size())) if LETTERS.fullmatch(p.removeprefix(START) or "-")}
    return sorted(unicodedata.normalize("NFC", p) for p in kept)


@dataclass
class LanguageModel:
    """``logs[piece]`` are the piece's log probabilities by language; ``unknown`` those of any character."""

    langs: list[str]
    logs: dict[str, np.ndarray]
    unknown: np.ndarray
    longest: int


class Scorer:
    """Word log-likelihoods by language, kept in a bounded table per worker."""

    def __init__(self, model: LanguageModel, keep_words: int = 400_000):
        self.n = len(model.langs)
        self.langs, self.longest, self.keep_words = model.langs, model.longest, keep_words
        self.probs = {p: tuple(float(x) for x in np.exp(v)) for p, v in model.logs.items()}
        self.unknown = tuple(float(x) for x in np.exp(model.unknown))
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, self.n))

    def forward(self, word: str) -> np.ndarray:
        """Log of the summed probability of all segmentations of a marked word, by language."""
        probs, unknown, n, longest = self.probs, self.unknown, len(word), self.longest
        if self.n == 4:  # the same sums, written out
            u0, u1, u2, u3 = unknown
            a0, a1, a2, a3 = [1.0] + [0.0] * n, [1.0] + [0.0] * n, [1.0] + [0.0] * n, [1.0] + [0.0] * n
            for j in range(1, n + 1):
                i = j - 1
                s0, s1, s2, s3 = a0[i] * u0, a1[i] * u1, a2[i] * u2, a3[i] * u3
                for i in range(max(0, j - longest), j):
                    p = probs.get(word[i:j])
                    if p is not None:
                        s0 += a0[i] * p[0]
                        s1 += a1[i] * p[1]
                        s2 += a2[i] * p[2]
                        s3 += a3[i] * p[3]
                a0[j], a1[j], a2[j], a3[j] = s0, s1, s2, s3
            return np.log(np.array([a0[n], a1[n], a2[n], a3[n]]) + 1e-300)
        return self.forward_rescaled(word)

    def forward_rescaled(self, word: str, every: int = 24) -> np.ndarray:
        """The same for a word of any length: the sums still needed are divided by the last one now and then."""
        alpha, logs, u = deque([np.ones(self.n)], max(self.longest, 1)), np.zeros(self.n), np.array(self.unknown)
        for j in range(1, len(word) + 1):
            s = alpha[-1] * u
            for k in range(1, len(alpha) + 1):
                p = self.probs.get(word[j - k : j])
                if p is not None:
                    s = s + alpha[-k] * np.array(p)
            alpha.append(s)
            if j % every == 0:
                s = np.maximum(s, 1e-300)
                logs += np.log(s)
                for k in range(len(alpha)):
                    alpha[k] = alpha[k] / s
        return np.log(alpha[-1] + 1e-300) + logs

    def add(self, word: str) -> int:
        at = len(self.index)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.forward(START + word) if len(word) <= MAX_WORD else self.forward_rescaled(START + word)
        self.index[word] = at
        return at

    def evidence(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words and the text's log-likelihood by language."""
        words = words_of(text)
        if not words:
            return 0, np.zeros(self.n)
        if len(self.index) >= self.keep_words:
            self.index.clear()
        get, add = self.index.get, self.add
        ids = [i if (i := get(w)) is not None else add(w) for w in words]
        return len(words), self.table[ids].sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        n, total = self.evidence(text or "")
        if n == 0 or not self.langs:
            return UNKNOWN, 0.0
        best = int(np.argmax(total))
        return self.langs[best], float(1.0 / np.exp((total - total[best]) / np.sqrt(n)).sum())


def learn_pieces(counts: Counter, pieces: list[str], rounds: int = 4, least: float = 1e-7) -> tuple[np.ndarray, float]:
    """Piece log probabilities of one language (last entry: any other character) by EM over word counts.

    Expected piece counts come from forward and backward sums over all segmentations."""
    index = {p: k for k, p in enumerate(pieces)}
    longest = max((len(p) for p in pieces), default=1)
    # per word: (letters, count, end of its arcs); an arc is (start, stop, piece) of a piece inside, the unknown
    # character included, and all arcs lie in three flat arrays (a tuple each takes five times the memory)
    words, starts, stops, held = [], array("i"), array("i"), array("i")
    long_words = [(START + word, n) for word, n in counts.items() if len(word) > MAX_WORD]
    for word, n in counts.items():
        if len(word) <= MAX_WORD:
            w = START + word
            own = [(i, j, k) for j in range(1, len(w) + 1) for i in range(max(0, j - longest), j) if (k := index.get(w[i:j])) is not None]
            own += [(i, i + 1, len(pieces)) for i in range(len(w))]
            for i, j, k in sorted(own, key=lambda a: (a[1], a[0])):
                starts.append(i)
                stops.append(j)
                held.append(k)
            words.append((len(w), n, len(held)))
    probs = [1.0 / len(pieces)] * len(pieces) + [1e-4]
    for _ in range(rounds):
        expected = [0.0] * (len(pieces) + 1)
        begin = 0
        for size, n, end in words:
            own = [*zip(starts[begin:end], stops[begin:end], held[begin:end])]
            begin = end
            alpha, beta = [1.0] + [0.0] * size, [0.0] * size + [1.0]
            for i, j, k in own:
                alpha[j] += alpha[i] * probs[k]
            for i, j, k in reversed(own):
                beta[i] += beta[j] * probs[k]
            scale = n / alpha[size] if alpha[size] > 0 else 0.0
            for i, j, k in own:
                expected[k] += alpha[i] * probs[k] * beta[j] * scale
        for w, n in long_words:
            expect_long(w, n, index, longest, probs, expected)
        total = sum(expected) or 1.0
        probs = [max(e / total, least) for e in expected]
        probs[-1] = least
    return np.log(np.array(probs[:-1])), float(np.log(least))


def expect_long(w: str, n: int, index: dict[str, int], longest: int, probs: list[float], expected: list[float]) -> None:
    """Adds the expected piece counts of a long word, in logarithms and one place at a time, so that neither
    the numbers nor the pieces inside grow with the word."""
    other, logs = len(probs) - 1, [math.log(p) for p in probs]

    def ending(j: int) -> list[tuple[int, int]]:
        return [(i, k) for i in range(max(0, j - longest), j) if (k := index.get(w[i:j])) is not None] + [(j - 1, other)]

    def starting(i: int) -> list[tuple[int, int]]:
        return [(j, k) for j in range(i + 1, min(len(w), i + longest) + 1) if (k := index.get(w[i:j])) is not None] + [(i + 1, other)]

    def log_sum(terms: list[float]) -> float:
        top = max(terms)
        return top + math.log(sum(math.exp(t - top) for t in terms))

    size = len(w)
    alpha, beta = [0.0] * (size + 1), [0.0] * (size + 1)
    for j in range(1, size + 1):
        alpha[j] = log_sum([alpha[i] + logs[k] for i, k in ending(j)])
    for i in range(size - 1, -1, -1):
        own = starting(i)
        beta[i] = log_sum([beta[j] + logs[k] for j, k in own])
        for j, k in own:
            expected[k] += n * math.exp(alpha[i] + logs[k] + beta[j] - alpha[size])


def learn(rows: DataFrame, pieces: list[str]) -> LanguageModel:
    """Model from labelled rows (``text, lang``). Each language is learned in a task of its own from the counts
    of all its words, so the number of rows given bounds the task; the driver gets one model row per language."""
    schema = "lang string, word string, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text or ""))
        for lang, words in found.items():
            items = list(words.items())
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(items), "word": [w for w, _ in items], "n": [n for _, n in items]})

    words = rows.select("text", "lang").mapInArrow(count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "word"], ascending=[False, True])
        logs, other = learn_pieces(Counter(dict(zip(group["word"], group["n"]))), pieces)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "logs": [logs.astype("float64").tobytes()], "other": [other]})

    fitted = sorted(words.groupBy("lang").applyInPandas(fit, "lang string, logs binary, other double").collect(), key=lambda r: r.lang)
    if not fitted:
        return LanguageModel([], {}, np.zeros(0), 1)
    logs = np.stack([np.frombuffer(r.logs) for r in fitted], axis=1)
    useful = np.flatnonzero((logs > logs.min() + 1e-9).any(axis=1))
    return LanguageModel([r.lang for r in fitted], {pieces[k]: logs[k] for k in useful}, np.array([r.other for r in fitted]), max(len(pieces[k]) for k in useful))


_SCORERS: dict[str, Scorer] = {}


def predict_column(spark, model: LanguageModel) -> Column:
    """Struct column ``(lang_pred, score)`` of the ``text`` column. The broadcast model is bounded by the
    vocabulary times the languages."""
    shared = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame([_SCORERS[key].predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(F.col("text"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_split(docs: DataFrame, vocab_path: str | None = None, sample_rows: int = 8_000, least_rows: int = 2_000) -> LanguageModel:
    """Model from the rows outside the held-out quarter. Each language is learned from about an equal part
    of ``sample_rows`` rows, but from ``least_rows`` at least: those whose id's hash falls into that share of
    its range (all of them if there are fewer), so no labelled language is lost however rare it is."""
    pieces = public_pieces(tokenizer_path("piece_bpe_32k.model", vocab_path))
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    wanted = max(sample_rows / max(len(counts), 1), least_rows)
    bounds = [F.lit(x) for lang, n in counts.items() if n > wanted for x in (lang, int(wanted / n * (1 << 30)))]
    if bounds:
        bound = F.coalesce(F.create_map(*bounds)[F.col("lang")], F.lit(1 << 30))
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bound)
    return learn(labelled, pieces)


def predict_languages_of(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` with the prediction in ``_found`` (``lang_pred``, ``score``)."""
    return docs.withColumn("_found", predict_column(docs.sparkSession, model))


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row, from the text alone."""
    found = predict_languages_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_found.lang_pred", "_found.score")
