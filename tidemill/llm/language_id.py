"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A
word's likelihood is the sum over all its segmentations into pieces, by a forward
algorithm; the expected piece counts of a forward-backward pass train the
probabilities (expectation maximisation). A text's likelihood is the product over
its words; its language is the most likely one, its score the posterior.

Words are the runs of letters (Unicode category L) in lower case, each with the
vocabulary's word mark. The forward algorithm sums over all segmentations of a word of
any length; that of a long word runs on logarithms. Training takes about ``train_rows`` labelled rows of each language at most, by a hash of
doc_id; what reaches the driver is a number for each piece and language.

Defined results: a text that is null, empty or without a letter is ``und`` with
score 0, as is every text if no row is labelled; equal likelihoods go to the
language that is first in the alphabet; repeated rows give repeated results; rows
with a null doc_id are held out; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scratch, words
from tidemill.operators.slices import fresh

MARK = "▁"
#: Labelled rows of a language in training; rounds of expectation maximisation.
TRAIN_ROWS, ITERATIONS = 3000, 3
#: A letter outside the vocabulary has this probability.
UNKNOWN = 1e-8
#: Words up to this length can't underflow; the sums of longer ones are kept as logarithms, in blocks of so many letters.
SHORT, BLOCK = 24, 4096
#: Text bytes that are scored together, whose words may all be new, and bytes that a worker remembers of strings.
SLICE_BYTES, REMEMBERED = 1 << 20, 48 << 20
#: Training rows are chosen by a hash of so many values.
HASHES = 1 << 48
_LETTERS = regex.compile(r"\p{L}+")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a sentencepiece model that are letters, in lower case, with or without the word mark."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or piece_path())
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(x for x in found if x.removeprefix(MARK).isalpha() or x == MARK)


def in_words(text: str) -> list[str]:
    """The marked words of a text."""
    return [MARK + word for word in _LETTERS.findall(text.lower())]


def _signs(group: list[str], size: int) -> np.ndarray:
    """Code points of strings of one length, a row each."""
    return np.array(group, f"<U{size}").view("<u4").reshape(len(group), size).astype(np.uint64)


def _append(code: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """The 64-bit code of strings with one more sign."""
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (sign + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return code ^ (code >> np.uint64(32))


class Model:
    """Piece probabilities by language, and the likelihoods of words under them."""

    def __init__(self, languages: list[str], pieces: list[str], table: np.ndarray):
        self.key, self.languages = uuid.uuid4().hex, languages
        #: By length, the codes of the pieces in order, and their numbers.
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, at in _by_length(pieces, len(pieces)):
            signs, code = _signs([pieces[k] for k in at], size), np.zeros(len(at), np.uint64)
            for j in range(size):
                code = _append(code, signs[:, j])
            order = np.argsort(code)
            self.known[size] = code[order], at[order]
        self.longest = max(self.known, default=1)
        # the last two rows: an unknown letter, and a string that is no piece
        self.table = np.vstack((table, np.full((1, table.shape[1]), UNKNOWN), np.zeros((1, table.shape[1]))))

    def _numbers(self, size: int, code: np.ndarray) -> np.ndarray | None:
        """The piece numbers of strings of one length by their codes; None if no piece has it."""
        if size not in self.known:
            return None
        codes, number = self.known[size]
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return np.where(codes[at] == code, number[at], len(self.table) - 1)

    def _steps(self, group: list[str], size: int) -> dict[tuple[int, int], np.ndarray]:
        """The piece numbers of all substrings, as far as any is a piece."""
        signs, none, out = _signs(group, size), len(self.table) - 1, {}
        for i in range(size):
            code = np.zeros(len(group), np.uint64)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                code = _append(code, signs[:, j - 1])
                found = self._numbers(j - i, code)
                if j == i + 1:
                    found = np.full(len(group), none) if found is None else found
                    found[found == none] = none - 1
                if found is not None and (found != none).any():
                    out[i, j] = found
        return out

    def _forward(self, steps: dict, count: int, size: int) -> np.ndarray:
        alpha = np.zeros((size + 1, count, self.table.shape[1]))
        alpha[0] = 1
        for (i, j), found in sorted(steps.items(), key=lambda x: x[0][1]):
            alpha[j] += alpha[i] * self.table[found]
        return alpha

    def _windows(self, word: str, first: int, last: int) -> np.ndarray:
        """For the ends first+1 ... last the piece numbers of the substrings of 1, 2, ... letters that stop there."""
        low = max(0, first - self.longest)
        signs, none = _signs([word[low:last]], last - low)[0], len(self.table) - 1
        out = np.full((last - first, self.longest), none)
        code = np.zeros(len(signs), np.uint64)  # of the substrings that begin at each place
        for size in range(1, min(self.longest, len(signs)) + 1):
            code = _append(code[: len(signs) - size + 1], signs[size - 1 :])
            found = self._numbers(size, code)
            found = np.full(len(code), none) if found is None else found
            if size == 1:
                found[found == none] = none - 1
            ends = np.arange(size, len(signs) + 1) + low
            inside = ends > first
            out[ends[inside] - first - 1, size - 1] = found[inside]
        return out

    def _long(self, word: str) -> np.ndarray:
        """Log probabilities of the beginnings of a long word, of 0, 1, ... letters, in each language."""
        size, width = len(word), self.table.shape[1]
        logs = np.full((size + 1, width), -np.inf)
        logs[0] = 0
        for first in range(0, size, BLOCK):
            chance = self.table[self._windows(word, first, min(size, first + BLOCK))]
            for k in range(len(chance)):
                end = first + k + 1
                back = min(self.longest, end)
                before = logs[end - back : end][::-1]
                # the last beginning is the scale: a letter more is never impossible, so the others are not far from it
                logs[end] = before[0] + np.log((chance[k, :back] * np.exp(before - before[0])).sum(0))
        return logs

    def _expected_long(self, word: str, times: np.ndarray, out: np.ndarray) -> None:
        """Adds the expected uses of each piece in a long word that occurs ``times`` in each language."""
        size, alpha = len(word), self._long(word)
        beta = np.full_like(alpha, -np.inf)
        beta[size] = 0
        reach = self.longest
        for last in range(size, 0, -BLOCK):
            first = max(0, last - BLOCK)
            stop = min(size, last + reach)
            chance = self.table[self._windows(word, first, stop)]
            for at in range(last - 1, first - 1, -1):
                ahead = min(reach, size - at)
                rows = np.arange(ahead)
                after = beta[at + 1 : at + 1 + ahead]
                beta[at] = after[0] + np.log((chance[at - first + rows, rows] * np.exp(after - after[0])).sum(0))
        for first in range(0, size, BLOCK):
            found = self._windows(word, first, min(size, first + BLOCK))
            for length in range(1, reach + 1):
                ends = np.arange(max(first + 1, length), first + len(found) + 1)
                piece = found[ends - first - 1, length - 1]
                uses = times * self.table[piece] * np.exp(alpha[ends - length] + beta[ends] - alpha[size])
                for k in range(out.shape[1]):
                    out[:, k] += np.bincount(piece, uses[:, k], len(out))

    def likelihood(self, given: list[str]) -> np.ndarray:
        """Log probability of each word in each language, over all segmentations."""
        out = np.zeros((len(given), self.table.shape[1]))
        for size, at in _by_length(given):
            group = [given[k] for k in at]
            if size > SHORT:
                out[at] = [self._long(word)[size] for word in group]
            else:
                out[at] = np.log(self._forward(self._steps(group, size), len(group), size)[size])
        return out

    def expected(self, given: list[str], times: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in each language, for words that occur ``times`` (word, language)."""
        out = np.zeros(self.table.shape)
        for size, at in _by_length(given):
            group = [given[k] for k in at]
            if size > SHORT:
                for k, word in zip(at.tolist(), group, strict=True):
                    self._expected_long(word, times[k], out)
                continue
            steps = self._steps(group, size)
            alpha = self._forward(steps, len(group), size)
            beta = np.zeros_like(alpha)
            beta[size] = times[at] / alpha[size]
            for (i, j), found in sorted(steps.items(), key=lambda x: -x[0][0]):
                beta[i] += beta[j] * self.table[found]
            for (i, j), found in steps.items():
                uses = alpha[i] * self.table[found] * beta[j]
                for k in range(out.shape[1]):
                    out[:, k] += np.bincount(found, uses[:, k], len(out))
        return out[:-2]


def _by_length(given: list[str], limit: int = 4_000) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, given), np.int64, len(given))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        for k in range(0, len(at), limit):
            yield size, at[k : k + limit]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training doesn't see: CRC-32 of the id's text is 2 modulo 4, or there is no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, iterations: int = ITERATIONS, path: str | None = None) -> Model | None:
    """Fit on the rows that are labelled and not held out; None if there are none."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)).alias("h"))
    share = {r["lang"]: min(1.0, train_rows / r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return None
    languages, pieces = sorted(share), vocabulary(path)
    limit = F.create_map(*(F.lit(x) for lang in languages for x in (lang, max(1, int(share[lang] * HASHES)))))
    number = {x: i for i, x in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                seen[lang].update(in_words(text))
        for lang, found in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([number[lang]] * len(found), pa.int32()), pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    seen = labelled.where(F.col("h") < limit[F.col("lang")]).select("lang", "text").mapInArrow(words.returning(counted), "lang int, word string, n long")
    by_lang = [F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))), F.lit(0)).cast("double") for k in range(len(languages))]
    seen = scratch.table(seen.groupBy("word").agg(F.array(*by_lang).alias("times")), "words")
    model = Model(languages, pieces, np.full((len(pieces), len(languages)), 1 / len(pieces)))
    for _ in range(iterations):

        def uses(frames: Iterator[pd.DataFrame], model: Model = model) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(model.table) - 2, len(model.languages)))
            for frame in frames:
                if len(frame):
                    total += model.expected(frame["word"].tolist(), np.stack(frame["times"]))
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "uses": total[piece, lang]})

        found = seen.mapInPandas(words.returning(uses), "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).collect()
        table = np.full((len(pieces), len(languages)), 0.05)
        for r in found:
            table[r["piece"], r["lang"]] += r["uses"]
        model = Model(languages, pieces, table / table.sum(0))
    return model


class Scorer:
    """Sums of word likelihoods by text; what is known of a string between blanks stays with the worker."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.languages)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.values, self.bytes = np.zeros((1 << 12, self.width + 1)), 0

    def _learn(self, strings: list[str]) -> None:
        parts = [in_words(x) for x in strings]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        place = {w: k for k, w in enumerate(sorted({w for p in parts for w in p}))}
        likelihood = self.model.likelihood(list(place))
        used = np.fromiter((place[w] for p in parts for w in p), np.int64, int(sizes.sum()))
        first, last = len(self.slot), len(self.slot) + len(strings)
        while last > len(self.values):
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
        for k in range(self.width):
            self.values[first:last, k] = np.bincount(np.repeat(np.arange(len(parts)), sizes), likelihood[used, k], len(parts))
        self.values[first:last, -1] = sizes
        self.slot.update(zip(strings, range(first, last), strict=True))
        self.bytes += sum(map(len, strings)) + (words.ENTRY_BYTES + 8 * self.width) * len(strings)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood by language, and the number of words, of each text."""
        words.hold(self)
        if self.bytes > REMEMBERED:
            self.forget()
        strings, index, begin = words.split(texts, None)
        if new := [x for x in strings if x not in self.slot]:
            self._learn(new)
        slots = np.fromiter((self.slot[x] for x in strings), np.int64, len(strings))[index]
        total = np.add.reduceat(self.values[slots], begin[:-1]) if len(texts) else np.zeros((0, self.width + 1))
        return total[:, :-1], total[:, -1]


_scorers: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    if model.key not in _scorers:
        _scorers.clear()
        _scorers[model.key] = Scorer(model)
    return _scorers[model.key]


def annotate(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (replaced if there), from each whole text alone; only texts go to Python."""

    def work(column: pa.Array) -> pa.Array:
        names, scores = [], []
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        for part in words.slices(batch, "text", SLICE_BYTES) if model else ():
            total, count = _scorer(model)(words.texts(part, "text"))
            odds = np.exp(total - total.max(1, keepdims=True))
            names += [model.languages[b] if n else "und" for b, n in zip(odds.argmax(1).tolist(), count.tolist(), strict=True)]
            scores.append(np.where(count > 0, 1 / odds.sum(1), 0.0))
        if not names:
            names, scores = ["und"] * len(column), [np.zeros(len(column))]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=["lang_pred", "score"])

    # said to be nondeterministic, or a filter on the result would score each text again
    score = F.arrow_udf(work, "struct<lang_pred string, score double>").asNondeterministic()
    docs = docs.drop("lang_pred", "score")
    (name,) = fresh(docs.columns, "scored")
    found = docs.withColumn(name, score(F.col("text").cast("string")))
    return found.select(*docs.columns, f"{name}.lang_pred", f"{name}.score")


def predict(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, by a model trained on ``docs``."""
    given = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return annotate(given, train(docs, train_rows)).select("doc_id", "held_out", "lang_pred", "score")
