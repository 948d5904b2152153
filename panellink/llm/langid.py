"""Language of code-switched text: a linear-chain conditional random field over words."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panellink.llm.common import col_of

#: A letter, and the letters and marks (vowel signs, accents) that follow it.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Labelled rows that the field is fitted on, at most (those with the smallest digests of their id), the bytes of
#: their texts together, and the words after which no more rows are taken for training sequences.
MAX_LABELLED, MAX_BYTES, MAX_WORDS = 3_000, 16_000_000, 400_000
#: Slots that features are hashed to; words whose potentials a worker keeps.
SLOTS, KEPT_WORDS = 1 << 16, 200_000
#: Words in a training sequence, and the mean length of a stretch of one language in it.
SEQUENCE, STRETCH = 48, 16
#: A word is in a language's lexicon with this many training occurrences and this share of them in the language.
LEXICON_COUNT, LEXICON_SHARE = 20, 0.9
#: Texts whose words are held at once in a worker.
GROUP = 512


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    weights: np.ndarray  #: (SLOTS, labels)
    transitions: np.ndarray  #: (labels, labels), logs
    start: np.ndarray  #: logs
    lexicon: dict[str, int]


def _hashed(codes: np.ndarray, at: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Slots of the ``n`` characters from each of ``at`` on."""
    h = np.full(len(at), 0x9E3779B97F4A7C15 + kind * 0x632BE59BD9B4E019 & (1 << 64) - 1, np.uint64)
    for j in range(n):
        h = (h ^ codes[at + j]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % SLOTS


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) pairs: each word's bias, affixes of one to three letters, bigrams, trigrams and lexicon."""
    marked = [f"\x02{w}\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    starts, word, place = ends - sizes, np.repeat(np.arange(len(words)), sizes), np.arange(len(codes))
    every = np.arange(len(words))
    slots, owners = [np.zeros(len(words), np.int64)], [every]
    for n in (2, 3):
        at = place[place + n <= ends[word]]
        slots.append(_hashed(codes, at, n, n))
        owners.append(word[at])
    for n in (2, 3, 4):
        fits = every[sizes >= n]
        slots += [_hashed(codes, starts[fits], n, 10 + n), _hashed(codes, ends[fits] - n, n, 20 + n)]
        owners += [fits, fits]
    known = np.array([k for k, w in enumerate(words) if w in lexicon], np.int64)
    slots.append(1 + np.array([lexicon[words[k]] for k in known], np.int64))
    owners.append(known)
    return np.concatenate(slots), np.concatenate(owners)


def _potentials(words: list[str], weights: np.ndarray, lexicon: dict[str, int]) -> np.ndarray:
    """(words, labels): summed weights of each word's features."""
    out = np.zeros((len(words), weights.shape[1]))
    for k in range(0, len(words), 20_000):
        part = words[k : k + 20_000]
        slots, owners = word_features(part, lexicon)
        for label in range(weights.shape[1]):
            out[k : k + len(part), label] = np.bincount(owners, weights[slots, label], len(part))
    return out


def forward_backward(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of sequences laid out one after another in ``emit`` (positions, labels), longest first.

    All sequences advance together, a position at a time.  With ``pairs``, also the expected transition counts,
    the expected starts and the log partition sum.
    """
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    shift = emit.max(axis=1, keepdims=True)
    e = np.exp(emit - shift)
    t = np.exp(transitions)
    alpha, beta, norm = np.empty_like(e), np.empty_like(e), np.ones((len(e), 1), e.dtype)
    longest = int(lengths[0]) if len(lengths) else 0
    live = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")  # sequences longer than each position
    for i in range(longest):
        at = first[: live[i]] + i
        a = e[at] * (np.exp(start) if i == 0 else alpha[at - 1] @ t)
        norm[at] = a.sum(axis=1, keepdims=True)
        alpha[at] = a / norm[at]
    for i in range(longest - 1, -1, -1):
        at = first[: live[i]] + i
        n = live[i + 1] if i + 1 < longest else 0
        beta[at[n:]] = 1.0
        if n:
            nxt = at[:n] + 1
            beta[at[:n]] = ((beta[nxt] * e[nxt]) @ t.T) / norm[nxt]
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    if not pairs:
        return gamma
    nxt = np.setdiff1d(np.arange(len(e)), first, assume_unique=True)
    counts = t * (alpha[nxt - 1].T @ (beta[nxt] * e[nxt] / norm[nxt]))
    return gamma, counts, gamma[first].sum(axis=0), float(np.log(norm).sum() + shift.sum())


def training_sequences(texts: list[tuple[str, str]], labels: tuple[str, ...], max_words: int, seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, gold labels, lengths): sequences that switch between stretches of rows of different languages."""
    rng = np.random.default_rng(seed)
    pools = [[] for _ in labels]
    budget = max(1, max_words // len(labels))
    for text, lang in texts:
        pool = pools[labels.index(lang)]
        if len(pool) < budget:
            pool += WORD.findall(text.lower())
    used = [0] * len(labels)
    words, gold, lengths = [], [], []
    while True:
        left = [k for k in range(len(labels)) if used[k] < len(pools[k])]
        if not left:
            return words, np.array(gold, np.int64), np.array(lengths, np.int64)
        n = 0
        while n < SEQUENCE and left:
            k = int(rng.choice(left))
            take = pools[k][used[k] : used[k] + min(SEQUENCE - n, int(rng.geometric(1 / STRETCH)))]
            used[k] += len(take)
            words += take
            gold += [k] * len(take)
            n += len(take)
            left = [k for k in left if used[k] < len(pools[k])]
        lengths.append(n)


def train(texts: list[tuple[str, str]], max_words: int = MAX_WORDS, rounds: int = 60, rate: float = 0.4, ridge: float = 1e-6) -> LanguageModel:
    """Fit by full-batch adaptive gradient steps on the conditional likelihood of the training sequences."""
    labels = tuple(sorted({lang for _, lang in texts}))
    words, gold, lengths = training_sequences(texts, labels, max_words) if labels else ([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = len(labels)
    by_label: dict[str, Counter] = {}
    for w, k in zip(words, gold.tolist()):
        by_label.setdefault(w, Counter())[k] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in by_label.items() if c.total() >= LEXICON_COUNT and c.most_common(1)[0][1] >= LEXICON_SHARE * c.total()}
    weights, trans, start = np.zeros((SLOTS, max(n, 1))), np.zeros((n, n)), np.zeros(n)
    if n < 2 or not words:
        return LanguageModel(labels, weights, trans, start, lexicon)
    order = np.argsort(-lengths, kind="stable")
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    index = {w: i for i, w in enumerate(by_label)}
    ids = np.array([index[w] for w in words])
    place = np.concatenate([np.arange(first[k], first[k] + lengths[k]) for k in order])
    ids, gold, lengths = ids[place], gold[place], lengths[order]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    slots, owners = word_features(list(index), lexicon)
    one_hot = np.zeros((len(gold), n))
    one_hot[np.arange(len(gold)), gold] = 1
    nxt = np.setdiff1d(np.arange(len(gold)), first)
    seen = np.zeros((n, n))
    np.add.at(seen, (gold[nxt - 1], gold[nxt]), 1)
    seen_start = np.bincount(gold[first], minlength=n)
    sums = [np.full((SLOTS, n), 1e-8), np.full((n, n), 1e-8), np.full(n, 1e-8)]
    for _ in range(rounds):
        emit = np.stack([np.bincount(owners, weights[slots, k], len(index)) for k in range(n)], axis=1)[ids]
        gamma, counts, begins, _ = forward_backward(emit, lengths, trans, start, pairs=True)
        per_word = np.stack([np.bincount(ids, gamma[:, k] - one_hot[:, k], len(index)) for k in range(n)], axis=1)
        grads = [np.stack([np.bincount(slots, per_word[owners, k], SLOTS) for k in range(n)], axis=1) / len(gold) + ridge * weights, (counts - seen) / len(gold), (begins - seen_start) / len(gold)]
        for held, g, total in zip((weights, trans, start), grads, sums):
            total += g * g
            held -= rate * g / np.sqrt(total)
    return LanguageModel(labels, weights, trans, start, lexicon)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, max_labelled: int = MAX_LABELLED) -> LanguageModel:
    """Learn from rows with text and language whose crc32(id as text) mod 5 is not 0.

    Whole rows are taken in the order of the digest of their id, ``max_labelled`` rows and MAX_BYTES bytes at most; an id whose
    texts would pass that is skipped, not the end of the sample.
    """
    d = docs.select(col_of(docs, id_col).cast("string").alias("id"), col_of(docs, text_col).alias("text"), col_of(docs, lang_col).cast("string").alias("lang"))
    d = d.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("id").cast("binary")) % 5 != 0))
    sizes = d.groupBy("id").agg(F.sum(F.octet_length("text")).alias("bytes")).where(F.col("bytes") <= MAX_BYTES).orderBy(F.md5("id"), "id").limit(max_labelled)
    chosen, taken = [], 0
    for r in sizes.collect():  # max_labelled rows at most
        if taken + r["bytes"] <= MAX_BYTES:
            chosen.append((r["id"],))
            taken += r["bytes"]
    ids = docs.sparkSession.createDataFrame(chosen, "id string")
    rows = d.join(F.broadcast(ids), "id").select("id", "text", "lang").collect()  # MAX_BYTES at most
    return train([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (zlib.crc32(r["id"].encode()), r["id"], r["text"]))])


def _classify(texts: list[str | None], model: LanguageModel, ids: dict[str, int], table: list[np.ndarray]) -> list[tuple[str, float]]:
    """Language and score of each text: the label with the greatest mean marginal over words, weighted by letters."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if not model.labels:
        return out
    held = [(k, w) for k, w in ((k, WORD.findall(t.lower())) for k, t in enumerate(texts) if t) if w]
    held.sort(key=lambda x: -len(x[1]))
    if not held:
        return out
    words = [w for _, ws in held for w in ws]
    new = list({w for w in words if w not in ids})
    if new:
        if len(ids) + len(new) > KEPT_WORDS:
            ids.clear()
            table.clear()
            new = list(set(words))
        ids |= zip(new, range(len(ids), len(ids) + len(new)))
        table[:] = [np.concatenate([*table, _potentials(new, model.weights, model.lexicon)])]
    emit = table[0][np.fromiter(map(ids.__getitem__, words), np.int64, len(words))]
    lengths = np.array([len(ws) for _, ws in held])
    gamma = forward_backward(emit, lengths, model.transitions, model.start) * np.fromiter(map(len, words), np.float64, len(words))[:, None]
    sums = np.add.reduceat(gamma, np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0)
    sums /= sums.sum(axis=1, keepdims=True)
    for (k, _), best, s in zip(held, sums.argmax(axis=1), sums):
        out[k] = (model.labels[best], round(float(s[best]), 6))
    return out


def languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: only the whole text is an input.

    Texts that are null or have no letter are ``und`` with score 0; numbers such as superscripts or fractions aren't letters.  Very long
    texts are labelled whole.  Of languages with equal sums, the first in code point order is predicted.  Repeated rows get equal
    results; an empty table gives an empty result; a model without labels gives ``und`` throughout.
    """
    @pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids: dict[str, int] = {}
        table: list[np.ndarray] = []
        for texts in batches:
            found: list[tuple[str, float]] = []
            for k in range(0, len(texts), GROUP):
                found += _classify(texts.iloc[k : k + GROUP].tolist(), model, ids, table)
            yield pd.DataFrame(found, columns=["lang", "score"])

    return docs.select(col_of(docs, id_col).alias("doc_id"), of(col_of(docs, text_col)).alias("p")).select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def word_labels(text: str | None, model: LanguageModel) -> list[tuple[str, str, float]]:
    """(word, language, marginal) for the words of one text."""
    words = WORD.findall((text or "").lower())
    if not words or not model.labels:
        return []
    emit = _potentials(words, model.weights, model.lexicon)
    gamma = forward_backward(emit, np.array([len(words)]), model.transitions, model.start)
    return [(w, model.labels[int(g.argmax())], float(g.max())) for w, g in zip(words, gamma)]


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return languages(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
