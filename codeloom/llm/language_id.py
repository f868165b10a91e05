"""Language identification by interpolated Kneser-Ney models of characters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.llm.arrays import Spans, chunks, found, mix, word_spans
from codeloom.llm.store import column

#: Labelled documents that the models are fitted on, in all; the same number for each language.
SAMPLE_ROWS = 2000
ORDER = 4
#: A fifth of the sample calibrates scores and rejection and is not counted.
CALIBRATION = 5
#: Characters at which the spread of a text's entropy is taken to be about its value for long texts.
SHORT = 200.0
#: Rejection starts at so many times the deviation that one in a thousand calibration texts exceeds.
SLACK, LEAST = 2.5, 8.0

#: Bytes of text that are scored together.
TOGETHER = 1 << 18

_P = np.uint64(0x100000001B3)
_letters = np.zeros(0x110000, np.uint8)  # 0: not looked up yet, 1: other, 2: letter


def _is_letter(codes: np.ndarray) -> np.ndarray:
    new = codes[_letters[codes] == 0]
    for c in np.unique(new):
        _letters[c] = 2 if chr(c).isalpha() else 1
    return _letters[codes] == 2


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(code, context, word)`` of all letters, lower-cased, and of one end (0) after each run of letters.

    ``context[k]`` is the letter k + 1 places back in its run, or 0 before its beginning.
    """
    text = "\n".join(words).lower() + "\n"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    of_word = np.cumsum(codes == 10) - (codes == 10)
    letter = _is_letter(codes)
    codes = np.where(letter, codes, 0).astype(np.uint64)
    n = len(codes)
    place = np.arange(n)
    back = place - np.maximum.accumulate(np.where(letter, -1, place))  # letters since the last other character
    depth = np.where(letter, back - 1, 0)
    depth[1:] = np.where(letter[1:], depth[1:], back[:-1])
    use = letter.copy()
    use[1:] |= letter[:-1]
    at = np.flatnonzero(use)
    context = np.zeros((ORDER - 1, len(at)), np.uint64)
    for k in range(1, ORDER):
        context[k - 1] = np.where(depth[at] >= k, codes[np.maximum(at - k, 0)], 0)
    return codes[at], context, of_word[at]


def grams(code: np.ndarray, context: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order n = 1..ORDER the hashes of ``(gram, its first n - 1 symbols, its last n - 1)``."""
    out = []
    for n in range(1, len(context) + 2):
        head = np.full(len(code), n, np.uint64)
        tail = np.full(len(code), n - 1, np.uint64)
        for k in range(n - 1, 0, -1):
            head = head * _P + context[k - 1] + np.uint64(1)
            if k < n - 1:
                tail = tail * _P + context[k - 1] + np.uint64(1)
        gram = head * _P + code + np.uint64(1)
        tail = tail * _P + code + np.uint64(1)
        out.append((mix(gram), mix(head), mix(tail)))
    return out


@dataclass
class Models:
    """All languages side by side: sorted hashes of grams and contexts, a column per language.

    The probability of a symbol is ``share[gram] + rest[context] * (probability of the shorter gram)``: the discounted
    count, and the mass that the discount of the context frees.
    """

    langs: list[str]
    grams: list[np.ndarray]
    share: list[np.ndarray]
    contexts: list[np.ndarray]
    rest: list[np.ndarray]
    floor: float
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = LEAST

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word under each language, and its number of symbols."""
        code, context, word = symbols(words)
        p = np.full((len(code), len(self.langs)), self.floor, np.float64)
        for n, (gram, head, _) in enumerate(grams(code, context)):
            at, hit = found(self.grams[n], gram)
            c_at, c_hit = found(self.contexts[n], head)
            p *= np.where(c_hit[:, None], self.rest[n][c_at], 1.0)
            p += np.where(hit[:, None], self.share[n][at], 0.0)
        bits = -np.log2(p)
        total = np.stack([np.bincount(word, bits[:, j], len(words)) for j in range(len(self.langs))], 1)
        return total, np.bincount(word, minlength=len(words))

    def calibrated(self, margin: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.stack([np.ones(len(n)), margin, np.log1p(n)], 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))) if self.weights is not None else np.where(n > 0, 0.5, 0.0)

    def deviation(self, lang: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (entropy - self.centre[lang]) / (self.spread[lang] * np.sqrt(1 + SHORT / np.maximum(n, 1)))


def fit(counts: dict[str, dict[str, int]]) -> Models:
    """Kneser-Ney models from the words of each language with their counts.

    The highest order has the counts of its grams, a lower one the number of different symbols in front of its grams;
    the discount of an order is n1 / (n1 + 2 n2).  Below the lowest order lies the uniform distribution.
    """
    langs = sorted(counts)
    per_lang = []
    codes: set[int] = set()
    for lang in langs:
        words = list(counts[lang])
        code, context, word = symbols(words)
        codes.update(np.unique(code).tolist())
        weight = np.array([counts[lang][w] for w in words], np.int64)[word] if words else np.zeros(0, np.int64)
        orders = grams(code, context)
        stats: list = [None] * len(orders)
        above = None
        for n in range(len(orders) - 1, -1, -1):
            gram, head, tail = orders[n]
            keys, first, which = np.unique(gram, return_index=True, return_inverse=True)
            c = np.bincount(which, weight, len(keys)) if above is None else np.bincount(np.searchsorted(keys, above), minlength=len(keys)).astype(float)
            stats[n] = (keys, head[first], c)
            above = tail[first] if n else None
        per_lang.append(stats)
    floor = 1.0 / (len(codes) + 1)
    model = Models(langs, [], [], [], [], floor)
    for n in range(ORDER):
        keys = np.unique(np.concatenate([s[n][0] for s in per_lang])) if langs else np.zeros(0, np.uint64)
        heads = np.unique(np.concatenate([s[n][1] for s in per_lang])) if langs else np.zeros(0, np.uint64)
        share = np.zeros((len(keys), len(langs)))
        rest = np.ones((len(heads), len(langs)))
        for j, stats in enumerate(per_lang):
            own, head, c = stats[n]
            if not len(own):
                continue
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 else 0.5
            d = min(max(d, 0.05), 0.95)
            h = np.searchsorted(heads, head)
            total, kinds = np.bincount(h, c, len(heads)), np.bincount(h, minlength=len(heads))
            share[np.searchsorted(keys, own), j] = np.maximum(c - d, 0) / total[h]
            seen = kinds > 0
            # Counts below the discount free only themselves; here every count is at least 1 > d.
            rest[seen, j] = d * kinds[seen] / total[seen]
        model.grams.append(keys), model.share.append(share), model.contexts.append(heads), model.rest.append(rest)
    return model


def _scored(models: Models, batch: pa.RecordBatch):
    """Per row: ``(best language, entropy of it, margin to the next, symbols)``."""
    out = []
    for _, data, offsets in chunks(batch.column("text"), TOGETHER):
        rows, starts, ends = word_spans(data, offsets)
        _, first, which = np.unique(Spans(data).hashes(starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        bits, size = models.word_scores([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        n = np.bincount(rows, size[which], len(offsets) - 1)
        each = np.stack([np.bincount(rows, bits[which, j], len(offsets) - 1) for j in range(len(models.langs))], 1) / np.maximum(n, 1)[:, None]
        order = np.sort(each, axis=1)
        out.append((each.argmin(axis=1), order[:, 0], (order[:, 1] if order.shape[1] > 1 else order[:, 0] + 10) - order[:, 0], n))
    return [np.concatenate(x) for x in zip(*out)]


def _calibrate(models: Models, rows) -> None:
    """Scores and rejection from rows ``(lang, pred, entropy, margin, n)`` that were not counted."""
    k = len(models.langs)
    lang, pred, entropy, margin, n = (np.array(rows[c].tolist()) for c in ("lang", "pred", "entropy", "margin", "n"))
    usable = n > 0 if len(n) else np.zeros(0, bool)
    pred, entropy, margin, n = pred[usable].astype(int), entropy[usable].astype(float), margin[usable].astype(float), n[usable].astype(float)
    centre = float(np.median(entropy)) if len(entropy) else np.log2(1 / models.floor)
    spread = max(1.4826 * float(np.median(np.abs(entropy - centre))) if len(entropy) else 1.0, 0.02)
    models.centre, models.spread = np.full(k, centre), np.full(k, spread)
    for j in range(k):
        own = entropy[pred == j]
        if len(own) >= 30:
            models.centre[j] = np.median(own)
            models.spread[j] = max(1.4826 * np.median(np.abs(own - models.centre[j])), 0.02)
    if len(n):
        models.limit = max(LEAST, SLACK * float(np.quantile(models.deviation(pred, entropy, n), 0.999)))
        right = (np.array(models.langs)[pred] == lang[usable]).astype(float)
        x = np.stack([np.ones(len(n)), margin, np.log1p(n)], 1)
        w = np.zeros(3)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (right - p) - 1e-2 * w)
        models.weights = w


SCORED = "lang string, pred int, entropy double, margin double, n long"


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Models | None:
    """Models from labelled rows ``(doc_id, text, lang)``: at most about ``sample_rows`` of them, equally many per language.

    Rows are chosen by a hash of id and text; the driver gets the different words of the sample with their counts.
    Without any labelled text there is no model.
    """
    rows = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string"), column(docs, "lang", "string")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    each = max(1, sample_rows // len(sizes))
    grid = 1 << 30
    parts = F.create_map(*(x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(grid, grid * each // n)))))
    picked = rows.withColumn("h", F.xxhash64("doc_id", "text")).filter(F.pmod("h", F.lit(grid)) < F.element_at(parts, F.col("lang")))
    held = F.pmod(F.shiftright("h", 32), F.lit(CALIBRATION)) == 0
    word = F.explode(F.split("text", r"[\x20\x09-\x0D]+"))
    counted = picked.filter(~held).select("lang", word.alias("word")).filter("word != ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for lang, w, n in zip(counted["lang"], counted["word"], counted["n"]):
        counts[lang][w] = int(n)
    models = fit({lang: c for lang, c in counts.items() if c})
    if not models.langs:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                best, entropy, margin, n = _scored(shared.value, batch)
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(best.astype(np.int32)), pa.array(entropy), pa.array(margin), pa.array(n.astype(np.int64))], ["lang", "pred", "entropy", "margin", "n"])

    _calibrate(models, picked.filter(held).select("lang", "text").mapInArrow(score, SCORED).toPandas())
    return models


PREDICTED = "lang_pred string, score double, entropy double, rejected boolean"


def with_language(docs: DataFrame, models: Models | None) -> DataFrame:
    """``(row, lang_pred, score, entropy, rejected)``, row being each row of ``docs`` as a whole, so no names clash.

    A text is given the language whose model needs fewest bits per letter.  ``und`` with score 0: null text, text without
    letters, or no model.  ``score`` is the calibrated chance that the label would agree.  Rejected are ``und`` and texts
    that need far more bits than the calibration texts of their language; ties go to the language first by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf(StructType.fromDDL(PREDICTED))
    def predict(text: pa.Array) -> pa.Array:
        models, rows = shared.value, len(text)
        if models is None or not rows:
            new = [pa.array(["und"] * rows, pa.string()), pa.array(np.zeros(rows)), pa.nulls(rows, pa.float64()), pa.array([True] * rows, pa.bool_())]
        else:
            best, entropy, margin, n = _scored(models, pa.RecordBatch.from_arrays([text], ["text"]))
            none = n == 0
            odd = models.deviation(best, entropy, n) > models.limit
            lang = np.where(none, "und", np.array(models.langs, object)[best])
            new = [pa.array(lang.tolist(), pa.string()), pa.array(np.where(none, 0.0, models.calibrated(margin, n))), pa.array(entropy, mask=none), pa.array(none | odd)]
        return pa.StructArray.from_arrays(new, ["lang_pred", "score", "entropy", "rejected"])

    # Only the text goes to Python and nothing but the answer comes back; the rows wait in the engine.
    rows = docs.select(F.struct("*").alias("row"), predict(column(docs, "text", "string")).alias("answer"))
    return rows.select("row", "answer.*")


def third(docs: DataFrame):
    """crc32 of the id as text, modulo 3; a null id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(column(docs, "doc_id", "string"), F.lit("")), "UTF-8")), F.lit(3))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, entropy, rejected)``, one row per row; learns from rows that are not held out."""
    models = train(docs.filter(third(docs) != 1), sample_rows)
    rows = docs.select(column(docs, "doc_id", "long"), (third(docs) == 1).alias("held_out"), column(docs, "text", "string"))
    return with_language(rows, models).select("row.doc_id", "row.held_out", "lang_pred", "score", "entropy", "rejected")
