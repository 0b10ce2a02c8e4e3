"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A text is its runs of letters in lower case; the models see each run with a start and an end mark, so a run's
probability does not depend on its neighbours and is computed once per distinct run. N-grams are 64-bit hashes; for each
order one sorted array of n-grams and one of contexts hold a column per language, so one binary search serves all languages.
The language of lowest cross-entropy per symbol wins. A text is rejected if it has no letter or if that cross-entropy lies above
a level calibrated on labelled texts kept out of the counts, with more room the shorter the text.

The models learn from a bounded sample: whole texts of the smallest id hashes, up to ``SAMPLE_CHARS`` characters (and
``SAMPLE_DOCS`` texts) per language. Every document is scored, over its whole text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import give_back, keyed, mixed, small

ORDER = 5
SAMPLE_CHARS = 600_000
SAMPLE_DOCS = 2000
CALIBRATION = 5  # every so many sampled texts go to the calibration instead of the counts
OUTLIER = 12.0  # median deviations above the median
ROOM = 1.0
SHORT_ROOM = 12.0
CONFIDENT = 40  # symbols beyond which evidence no longer adds up: symbols of a text are not independent
CACHED_RUNS = 250_000
SYMBOLS_AT_ONCE = 1 << 17
ROWS_AT_ONCE = 1024
UNKNOWN = "und"
START, END = 2, 3


def runs_of(text: Column) -> Column:
    """The runs of letters of a text in lower case; empty strings may stand at the ends."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def sequences(runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all runs between their marks, position of each in its run, run of each)."""
    lens = np.fromiter(map(len, runs), np.int64, len(runs)) + 2
    codes = np.empty(int(lens.sum()), np.uint64)
    starts = np.cumsum(lens) - lens
    place = np.arange(len(codes)) - np.repeat(starts, lens)
    inner = (place > 0) & (place < np.repeat(lens, lens) - 1)
    codes[place == 0], codes[starts + lens - 1] = START, END
    codes[inner] = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, place, np.repeat(np.arange(len(runs)), lens)


def hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For n from 0 to ORDER, the hash of the n symbols that end at each place (across runs: not to be used)."""
    out = [np.zeros(len(codes), np.uint64)]
    for n in range(1, ORDER + 1):
        before = np.concatenate([[np.uint64(0)], out[-1][:-1]])
        out.append(mixed(before * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(n)))
    return out


class Counts:
    """Modified-count tables of one language: per order alpha by n-gram and gamma by context."""

    def __init__(self, runs: Counter):
        words = sorted(runs)
        codes, place, owner = sequences(words)
        weight = np.fromiter((runs[w] for w in words), np.float64, len(words))[owner]
        h, self.alpha, self.gamma = hashes(codes), [], []
        for n in range(1, ORDER + 1):
            at = np.flatnonzero((place >= max(1, n - 1)))
            key, first, back = np.unique(h[n][at], return_index=True, return_inverse=True)
            context = np.concatenate([[np.uint64(0)], h[n - 1][:-1]])[at][first] if n > 1 else np.zeros(len(key), np.uint64)
            count = np.bincount(back, weight[at], len(key))
            if n < ORDER:  # how many symbols it follows, unless it begins at the start mark
                more = np.flatnonzero(place >= max(1, n))
                _, one = np.unique(h[n + 1][more], return_index=True)
                follows = np.bincount(np.searchsorted(key, h[n][more][one]), minlength=len(key)).astype(float)
                begins = place[at][first] == n - 1
                count = np.where(begins | (follows == 0), count, follows)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
            contexts, group = np.unique(context, return_inverse=True)
            total = np.bincount(group, count)
            self.alpha.append((key, np.maximum(count - discount, 0) / total[group]))
            self.gamma.append((contexts, np.bincount(group, np.minimum(count, discount)) / total))


def merged(tables: list[tuple[np.ndarray, np.ndarray]], absent: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for k, _ in tables]))
    out = np.full((len(keys) + 1, len(tables)), absent, np.float32)  # the last row is for what isn't there
    for j, (k, v) in enumerate(tables):
        out[np.searchsorted(keys, k), j] = v
    return keys, out


class Model:
    """All languages' models, with a bounded per-worker cache of run scores."""

    def __init__(self, languages: list[str], counts: list[Counts], letters: int):
        self.languages, self.uniform = languages, 1.0 / (letters + 2)
        self.alpha = [merged([c.alpha[n] for c in counts], 0.0) for n in range(ORDER)] if counts else []
        self.gamma = [merged([c.gamma[n] for c in counts], 1.0) for n in range(ORDER)] if counts else []
        self.level = np.full(len(languages), np.inf)
        self.forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "bits", "symbols")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bits, self.symbols = np.zeros((1 << 14, len(self.languages)), np.float32), np.zeros(1 << 14, np.int64)

    def score(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each run under each language, symbols of each run)."""
        codes, place, owner = sequences(runs)
        h = hashes(codes)
        at = np.flatnonzero(place >= 1)
        p = np.full((len(at), len(self.languages)), self.uniform)
        for n in range(1, ORDER + 1):
            fits = place[at] >= n - 1
            own = at[fits]
            context = h[n - 1][own - 1] if n > 1 else np.zeros(len(own), np.uint64)
            p[fits] = found(self.alpha[n - 1], h[n][own]) + found(self.gamma[n - 1], context) * p[fits]
        starts = np.flatnonzero(np.concatenate([[True], owner[at][1:] != owner[at][:-1]]))  # each run has a symbol: its end mark
        return np.add.reduceat(-np.log2(p), starts, axis=0), np.bincount(owner[at], minlength=len(runs))

    def places(self, runs: list[str]) -> np.ndarray:
        if len(self.known) > CACHED_RUNS:
            self.forget()
        new = [r for r in runs if r not in self.known]
        at = 0
        while at < len(new):
            part, size = [], 0
            while at < len(new) and (not part or size + len(new[at]) < SYMBOLS_AT_ONCE):
                part.append(new[at])
                size += len(new[at]) + 2
                at += 1
            bits, symbols = self.score(part)
            base, n = len(self.known), len(self.known) + len(part)
            if n > len(self.symbols):
                more = max(n, 2 * len(self.symbols)) - len(self.symbols)
                self.bits = np.concatenate([self.bits, np.zeros((more, self.bits.shape[1]), np.float32)])
                self.symbols = np.concatenate([self.symbols, np.zeros(more, np.int64)])
            self.bits[base:n], self.symbols[base:n] = bits, symbols
            self.known.update(zip(part, range(base, n), strict=True))
        return np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))

    def texts(self, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each text under each language, its symbols) of a column of runs; a null text has none."""
        sizes = np.array([x or 0 for x in column.value_lengths().to_pylist()], np.int64)
        named = column.flatten().dictionary_encode()
        distinct = named.dictionary.to_pylist()
        at = self.places(distinct) if distinct else np.zeros(0, np.int64)
        blank = np.array([not r for r in distinct], bool)
        index = named.indices.to_numpy()
        bits, symbols = self.bits[at], self.symbols[at]
        bits[blank], symbols[blank] = 0, 0
        owner = np.repeat(np.arange(len(sizes)), sizes)
        out = np.stack([np.bincount(owner, bits[index, j], len(sizes)) for j in range(bits.shape[1])], axis=1) if len(self.languages) else np.zeros((len(sizes), 0))
        return out, np.bincount(owner, symbols[index], len(sizes))

    def entropies(self, bits: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return bits / np.maximum(symbols, 1)[:, None]

    def limit(self, best: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The cross-entropy above which a text of so many symbols is rejected."""
        return self.level[best] + SHORT_ROOM / np.sqrt(np.maximum(symbols, 1))

    def predict(self, column: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, accepted) of each text.

        The score is the share of the language among all languages and a reject class at the calibrated level, each weighing
        2 to the minus bits for ``CONFIDENT`` symbols at most; a text is accepted if its language outweighs the reject class.
        """
        if not self.languages:
            none = np.zeros(len(column))
            return [UNKNOWN] * len(column), none, none, np.zeros(len(column), bool)
        bits, symbols = self.texts(column)
        blank = symbols == 0
        entropy = self.entropies(bits, symbols)
        best = entropy.argmin(1)
        low = entropy[np.arange(len(best)), best]
        n = np.minimum(symbols, CONFIDENT)[:, None]
        gaps = np.concatenate([entropy, self.limit(best, symbols)[:, None]], axis=1) - low[:, None]
        weight = np.exp2(-np.clip(gaps * n, -60, 60))
        score = np.where(blank, 0.0, 1.0 / weight.sum(1))
        names = [UNKNOWN if b else self.languages[i] for i, b in zip(best, blank, strict=True)]
        return names, score, np.where(blank, 0.0, low), ~blank & (low <= self.limit(best, symbols))


def found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    own, values = table
    at = np.searchsorted(own, keys)
    return values[np.where((at < len(own)) & (own[np.minimum(at, len(own) - 1)] == keys), at, len(own))]


def sample(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text, lang) with all three, the bounded sample per language, as (lang, n, runs).

    Ids are chosen without their texts: a hash threshold per language leaves a few times ``SAMPLE_DOCS`` of them, a window picks the
    smallest hashes. Only then are texts read, by a broadcast of the chosen ids: ``SAMPLE_DOCS`` per language at most.
    """
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    ids = rows.select("doc_id", "lang", F.length("text").alias("chars"), F.xxhash64("doc_id").alias("h"))
    totals = ids.groupBy("lang").agg(F.count("*").alias("total"))
    near = ids.join(small(totals), "lang").where(F.pmod("h", F.lit(1 << 30)) * F.col("total") < F.lit(float(4 * SAMPLE_DOCS * (1 << 30))))
    # Texts that would take a large share of the budget come last, so one of them can't end the sample early.
    order = Window.partitionBy("lang").orderBy(F.col("chars") > SAMPLE_CHARS // 20, F.pmod("h", F.lit(1 << 30)), "h", "doc_id")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCS)
    near = near.withColumn("before", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars"))
    chosen = near.where(F.col("before") < SAMPLE_CHARS).groupBy("lang", "doc_id").agg(F.min("n").alias("n"))
    return rows.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "n", runs_of(F.col("text")).alias("runs"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the labelled rows of ``docs``; rows without id, text or label are passed over.

    The sample goes to the driver: at most ``SAMPLE_CHARS`` characters and one text per language.
    """
    rows = sample(keyed(docs, doc_id=id_col, text=text_col, lang=lang_col)).orderBy("lang", "n").toArrow()
    counts: dict[str, Counter] = {}
    checks: dict[str, list[list[str]]] = {}
    for lang, n, runs in zip(*(rows[c].to_pylist() for c in ("lang", "n", "runs")), strict=True):
        runs = [r for r in runs if r]
        if runs:
            if n % CALIBRATION != 2 or lang not in counts:  # with two texts one is held out
                counts.setdefault(lang, Counter()).update(runs)
            else:
                checks.setdefault(lang, []).append(runs)
    languages = sorted(counts)
    letters = {c for x in counts.values() for r in x for c in r}
    model = Model(languages, [Counts(counts[x]) for x in languages], len(letters))
    for j, lang in enumerate(languages):
        texts = checks.get(lang) or [list(counts[lang])]
        bits, symbols = model.texts(pa.array(texts, pa.list_(pa.string())))
        entropy = model.entropies(bits, symbols)[:, j] - SHORT_ROOM / np.sqrt(np.maximum(symbols, 1))
        long = symbols >= 200
        whole = model.entropies(bits, symbols)[long, j]
        model.level[j] = max(typical_top(whole) if long.any() else -np.inf, typical_top(entropy)) + ROOM
    model.forget()
    return model


def typical_top(values: np.ndarray) -> float:
    """The largest value that is no outlier: at most ``OUTLIER`` median deviations above the median (a mislabelled text doesn't lift a level)."""
    middle = np.median(values)
    spread = max(float(np.median(np.abs(values - middle))), 0.02)
    return float(values[values <= middle + OUTLIER * spread].max())


FOUND = "struct<lang_pred:string,score:double,entropy:double,accepted:boolean>"


def identified(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """``docs`` with the struct ``name`` of lang_pred, score, entropy and accepted.

    Only the runs of letters go to Python; the other columns wait in the JVM. The model is broadcast: its size is bounded by the sample.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(runs: pa.Array) -> pa.Array:
        parts = [sent.value.predict(runs.slice(at, ROWS_AT_ONCE)) for at in range(0, len(runs), ROWS_AT_ONCE)]
        give_back()
        names = pa.array([n for p in parts for n in p[0]], pa.string())
        score, entropy, accepted = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in (1, 2, 3))
        return pa.StructArray.from_arrays([names, pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(accepted, pa.bool_())], ["lang_pred", "score", "entropy", "accepted"])

    predict = F.arrow_udf(run, FOUND).asNondeterministic()  # so that no filter on its result makes it run twice
    return docs.withColumn(name, predict(runs_of(F.col(f"`{text_col}`"))))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, entropy, accepted) of each row; only the text counts, other columns are ignored.

    A null text, or one without letters, is ``und`` with score 0, and so is every text if nothing was learned. Ties go to the first
    language by code point. Rows repeat as they do in the input.
    """
    return identified(keyed(docs, doc_id=id_col, text=text_col), model, "text", "found").select("doc_id", "found.*")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all columns and ``lang_col`` set to the language found.

    Learns from the labelled rows of ``docs`` itself. Null texts and those without letters are rejected, as is every text if nothing was learned;
    repeated rows stay repeated, an empty table stays empty, and extra columns may have any name.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    numbered = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    rows = identified(numbered, train(docs, id_col, text_col, lang_col), names[text_col], "found").where("found.accepted")
    return rows.select(*[F.col("found.lang_pred" if c == lang_col else n).alias(c) for c, n in names.items()])
