"""Language identification by interpolated Kneser-Ney character models.

Texts are read as lower-case letters; every stretch of other characters is one boundary symbol. One model of
order 5 per language: the top order uses counts, lower orders continuation counts, each order its own absolute
discount n1 / (n1 + 2 n2), interpolated down to a uniform distribution. A model is, per order, two sorted
arrays of 64-bit gram hashes with their values (discounted probability of a gram; weight left to the lower order
of a context), searched by bisection. A text gets the language of the lowest cross-entropy in bits per symbol.

Rejection is calibrated on a tenth of the training sample that the counts leave out. A text's deviation is its
cross-entropy less the median of its language's calibration texts, times the root of its length (400 symbols at
most). A text is rejected if its deviation exceeds the 99 % quantile of all calibration texts' deviations (pooled over
languages, so that single odd texts do not set it), and `LEAST`, as small samples do not hold their own tail: at
most about 1 % of texts in a known language go. Text that is null or has no letter is `und` and rejected.

The classifier is fitted on a bounded sample: about `per_language` whole labelled texts and `PER_LANGUAGE_CHARS` characters
of each language (chosen by a hash of doc_id, so alike at every size; with more than `FULL_LANGUAGES` languages, each has
a smaller share), and at most `max_letters` letters in the alphabet. Every text is judged whole, however long. With no labelled text at all, every prediction is `und`. Ties go to the first language
name. Repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, give_back, stage_table

ORDER = 5
BITS = 12
MAX_LETTERS = (1 << BITS) - 2
PER_LANGUAGE, PER_LANGUAGE_CHARS = 1500, 6_000_000
#: about so many whole texts of a language are learned from at least, whatever the languages, and all of one that has fewer
LEAST_TEXTS = 50
#: more languages than this share the sample that so many would have
FULL_LANGUAGES = 40
CHUNK, MEMO = 500_000, 1_000_000
TEXTS = 400
#: the false-rejection quantile, the length from which deviations count alike, and the least limit (0.4 bits at that length)
ACCEPTED, FULL, LEAST = 0.99, 400, 8.0
UNDETERMINED = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits double, accepted boolean"


def is_letter_table() -> np.ndarray:
    """For each code point: is it a letter (also marks inside words of many scripts)."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text, each stretch of boundaries as one 0, with ORDER - 1 boundaries before them."""
    s = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    return np.concatenate((np.zeros(ORDER - 1, s.dtype), s[keep]))


def gram_keys(s: np.ndarray) -> np.ndarray:
    """Packed grams that end at each position from ORDER - 1 on."""
    n = len(s) - ORDER + 1
    key = np.zeros(n, np.int64)
    for i in range(ORDER):
        key = (key << BITS) | s[i : i + n]
    return key


def mix(key: np.ndarray) -> np.ndarray:
    """64-bit hash of packed grams (one-to-one)."""
    x = key.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sorted_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys)
    order = np.argsort(h)
    return h[order], values[order].astype(np.float32)


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where there is none), and where there is one."""
    h, values = table
    if not len(h):
        return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
    q = mix(keys)
    at = np.minimum(np.searchsorted(h, q), len(h) - 1)
    hit = h[at] == q
    return np.where(hit, values[at], np.float32(0)), hit


def fit_kneser_ney(keys: np.ndarray, counts: np.ndarray, n_symbols: int) -> dict:
    """One language's model from its order-5 grams."""
    model = {"uniform": 1.0 / (n_symbols + 2), "orders": []}
    tables = []
    for k in range(ORDER, 0, -1):
        tables.append((keys, counts))
        # continuation counts of the next lower order: distinct one-symbol extensions to the left
        low = keys & ((1 << (BITS * (k - 1))) - 1) if k > 1 else keys[:0]
        keys, counts = np.unique(low, return_counts=True)
    for keys, counts in reversed(tables):
        n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ctx = keys >> BITS
        ctx_keys, where = np.unique(ctx, return_inverse=True)
        total = np.bincount(where, weights=counts)
        kinds = np.bincount(where)
        model["orders"].append(
            {
                "gram": sorted_table(keys, np.maximum(counts - discount, 0) / total[where]),
                "context": sorted_table(ctx_keys, discount * kinds / total),
            }
        )
    return model


def gram_bits(model: dict, keys: np.ndarray) -> np.ndarray:
    """-log2 of each gram's probability given its context."""
    p = np.full(len(keys), model["uniform"])
    for k, t in enumerate(model["orders"], 1):
        gram = keys & ((1 << (BITS * k)) - 1)
        weight, known = look_up(t["context"], gram >> BITS)
        alpha, _ = look_up(t["gram"], gram)
        p = np.where(known, alpha + weight * p, p)
    return -np.log2(np.maximum(p, 1e-12))


class GramBits:
    """Bits of grams under each model, remembered in a sorted table of at most `MEMO` grams."""

    def __init__(self, models: list[dict]):
        self.models = models
        self.forget()

    def forget(self) -> None:
        self.keys, self.bits = np.zeros(0, np.int64), np.zeros((0, len(self.models)))

    def __call__(self, kinds: np.ndarray) -> np.ndarray:
        """grams x models, for distinct grams."""
        if len(self.keys) + len(kinds) > MEMO:
            self.forget()
        at = np.searchsorted(self.keys, kinds)
        new = np.ones(len(kinds), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != kinds[inside]
        if new.any():
            keys = np.sort(kinds[new])
            bits = np.stack([gram_bits(m, keys) for m in self.models], axis=1)
            where = np.searchsorted(self.keys, keys)
            self.keys, self.bits = np.insert(self.keys, where, keys), np.insert(self.bits, where, bits, axis=0)
            at = np.searchsorted(self.keys, kinds)
        return self.bits[at]


def cross_entropies(texts: list[np.ndarray], bits_of: GramBits) -> np.ndarray:
    """Bits per symbol of each symbol array (texts x models). Distinct grams are looked up once a chunk, and remembered."""
    out = np.zeros((len(texts), len(bits_of.models)))
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= CHUNK):
            n += len(texts[end])
            end += 1
        part = texts[at:end]
        code, kinds = pd.factorize(np.concatenate([gram_keys(s) for s in part]))
        sizes = np.array([len(s) - ORDER + 1 for s in part])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        bits = bits_of(kinds)
        for j in range(bits.shape[1]):
            out[at:end, j] = np.add.reduceat(bits[:, j][code], starts) / sizes
        at = end
    return out


def sample_texts(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text, calibration): about per_language texts and `PER_LANGUAGE_CHARS` characters of each language, by a hash
    of doc_id (of the text where there is no id); `LEAST_TEXTS` or all of them at least, so no language is lost."""
    learn = docs.select("doc_id", "lang", "text").where((fold("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = learn.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars")).collect()
    if not sizes:
        return learn.select("lang", "text", F.lit(False).alias("calibration"))
    part = min(1.0, FULL_LANGUAGES / len(sizes))
    rates = {r["lang"]: max(min(1.0, LEAST_TEXTS / r["n"]), part * min(1.0, per_language / r["n"], PER_LANGUAGE_CHARS / max(1, r["chars"]))) for r in sizes}
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
    key = (F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text")))
    u = F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    spared = [r["lang"] for r in sizes if r["n"] < LEAST_TEXTS]  # all of these languages' texts are counted
    held = (F.pmod(F.xxhash64(*key, F.lit("calibration")), F.lit(10)) == 0) & ~F.col("lang").isin(spared)
    return learn.where(u < rate).select("lang", "text", held.alias("calibration"))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, max_letters: int = MAX_LETTERS) -> dict:
    """Models and rejection limits. Counts are made on the workers; the sample bounds what reaches the driver."""
    sample = stage_table(sample_texts(docs, per_language), "sample")

    def count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = is_letter_table()
        counts = np.zeros(0x110000, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(counts, *np.unique(np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True))
        at = np.flatnonzero(counts * letter)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["letter", "n"])

    letters = sample.select("text").mapInArrow(count_letters, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    top = [r["letter"] for r in letters.orderBy(F.col("n").desc(), "letter").limit(max_letters).collect()]
    table = np.where(is_letter_table(), np.uint16(len(top) + 1), np.uint16(0))
    table[top] = np.arange(1, len(top) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, []).append(gram_keys(symbols(t, shared.value)))
        for lang, parts in seen.items():
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], names=["lang", "key", "n"])
        del seen
        give_back()

    grams = sample.where("not calibration").select("lang", "text").mapInArrow(count_grams, "lang string, key long, n long")
    grams = grams.groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "key"])
    names, models = [], []
    for lang, g in grams.groupby("lang", sort=True):
        names.append(lang)
        models.append(fit_kneser_ney(g["key"].to_numpy(np.int64), g["n"].to_numpy(np.int64), len(top)))
    model = {"names": names, "models": models, "table": table, "limits": [(np.inf, 0.0)] * len(names)}
    if names:
        model["limits"] = calibrate(sample.where("calibration").select("lang", "text"), model)
    return model


def calibrate(sample: DataFrame, model: dict) -> list[tuple[float, float]]:
    """(median bits, limit of deviations) of each language."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        bits_of = GramBits(m["models"])
        for b in batches:
            for first in range(0, b.num_rows, TEXTS):
                part = b.slice(first, TEXTS)
                texts = [symbols(t, m["table"]) for t in part.column(1).to_pylist()]
                at = [i for i, s in enumerate(texts) if s.any()]
                h = cross_entropies([texts[i] for i in at], bits_of) if at else np.zeros((0, 1))
                langs = part.column(0).to_pylist()
                own = [h[j, m["names"].index(langs[i])] if langs[i] in m["names"] else np.nan for j, i in enumerate(at)]
                yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in at], pa.string()), pa.array(own, pa.float64()), pa.array([len(texts[i]) - ORDER + 1 for i in at], pa.int64())], names=["lang", "bits", "n"])

    seen = sample.mapInArrow(run, "lang string, bits double, n long").toPandas()
    seen = seen[seen["bits"].notna()]
    center = seen.groupby("lang")["bits"].median()
    deviation = (seen["bits"] - seen["lang"].map(center)) * np.sqrt(seen["n"].clip(upper=FULL))
    limit = max(float(deviation.quantile(ACCEPTED)), LEAST) if len(seen) else 0.0
    enough = seen["lang"].value_counts()
    return [(float(center[lang]), limit) if enough.get(lang, 0) >= 5 else (np.inf, 0.0) for lang in model["names"]]


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits, accepted for each row of docs. score: the best language's
    share under a softmax of cross-entropies over at most 100 symbols."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 4) == 2).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        bits_of = GramBits(m["models"])
        for b in batches:
            lang, score, bits, ok = judge(b.column(2).to_pylist(), m, bits_of)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(ok, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "bits", "accepted"],
            )
        give_back()

    return rows.mapInArrow(run, SCHEMA)


def judge(texts: list[str | None], m: dict, bits_of: GramBits) -> tuple[list, list, list, list]:
    """lang, score, bits and accepted of each text, a few texts at a time."""
    n = len(texts)
    lang, score, bits, ok = [UNDETERMINED] * n, [0.0] * n, [None] * n, [False] * n
    for first in range(0, n if m["names"] else 0, TEXTS):
        read = [symbols(t, m["table"]) if t else None for t in texts[first : first + TEXTS]]
        at = [i for i, s in enumerate(read) if s is not None and s.any()]
        if not at:
            continue
        h = cross_entropies([read[i] for i in at], bits_of)
        best = h.argmin(axis=1)
        for j, i in enumerate(at):
            size, k = len(read[i]) - ORDER + 1, first + i
            center, limit = m["limits"][best[j]]
            lang[k], bits[k] = m["names"][best[j]], float(h[j, best[j]])
            score[k] = float(1 / np.exp2((h[j, best[j]] - h[j]) * min(size, 100)).sum())
            ok[k] = bool(h[j, best[j]] <= center + limit / np.sqrt(min(size, FULL)))
    return lang, score, bits, ok


def keep_identified(docs: DataFrame, model: dict) -> DataFrame:
    """docs without the rows that are rejected; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_of = GramBits(shared.value["models"])
        for b in batches:
            yield b.filter(pa.array(judge(b.column(at).to_pylist(), shared.value, bits_of)[3], pa.bool_()))
        del bits_of
        give_back()

    return docs.mapInArrow(run, docs.schema)
