"""Language-model scoring by a weighted backoff automaton."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import chunks, found, lowered, mix, words
from codeloom.llm.store import column, written

#: A bigram seen as often is an arc, at every size of corpus.
LEAST = 2
#: Relative frequencies (of all training tokens) from which on tokens with their states, and arcs, are broadcast as a first
#: tier.  Each bounds its table by the inverse; what is rarer is found by a join, so they decide nothing about the scores.
LOOKED_UP, ARC = 2.5e-7, 1e-6
#: Most bits of the table that tells which pairs are worth asking for; when it is full more are asked for, with the same scores.
BITS = 1 << 29
END = np.uint64(0x5E4D0F7E47)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of the words of each row and of the end behind them, left to right."""
    rows, _, _, hashes = words(lowered(data), offsets)
    n = len(offsets) - 1
    per_row = np.bincount(rows, minlength=n)
    at_end = np.cumsum(per_row + 1) - 1
    out = np.empty(len(rows) + n, np.uint64)
    inner = np.ones(len(out), bool)
    inner[at_end] = False
    out[inner], out[at_end] = hashes, END
    return np.repeat(np.arange(n), per_row + 1), out


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    u, at = np.unique(every, return_inverse=True)
    return u, np.bincount(at, np.concatenate(counts) if counts else None, len(u)).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _task_counts(pick):
    """Rows ``(key, n)`` of one task: what ``pick(data, offsets)`` yields, counted before anything is shuffled."""

    def run(batches):
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                u, c = np.unique(pick(data, offsets), return_counts=True)
                keys.append(u), counts.append(c)
                held += len(u)
                if held > 4_000_000:
                    u, c = _counted(keys, counts)
                    keys, counts, held = [u], [c], len(u)
                    if held > 2_000_000:
                        yield pa.RecordBatch.from_arrays([_signed(u), pa.array(c)], ["key", "n"])
                        keys, counts, held = [], [], 0
        u, c = _counted(keys, counts)
        for i in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([_signed(u[i : i + 100_000]), pa.array(c[i : i + 100_000])], ["key", "n"])

    return run


def _pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(mix(before + np.uint64(1)) ^ after)


def _inner(rows: np.ndarray) -> np.ndarray:
    """Places of tokens that have another one before them in their row."""
    return np.flatnonzero(rows[1:] == rows[:-1]) + 1


def _pair_counts(batches):
    """Rows ``(before, after, n)`` of one task, counted over some two million tokens at a time."""

    def counted(held):
        before, after = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.uint64),) * 2
        _, first, n = np.unique(_pair_keys(before, after), return_index=True, return_counts=True)
        for i in range(0, len(first), 100_000):
            here = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([_signed(before[first[here]]), _signed(after[first[here]]), pa.array(n[here])], ["before", "after", "n"])

    held, size = [], 0
    for batch in batches:
        for _, data, offsets in chunks(batch.column("text")):
            rows, hashes = tokens(data, offsets)
            at = _inner(rows)
            held.append((hashes[at - 1], hashes[at]))
            size += len(at)
            if size > 2_000_000:
                yield from counted(held)
                held, size = [], 0
    yield from counted(held)


def _keyed(batches):
    for batch in batches:
        before, after = (batch.column(c).to_numpy().view(np.uint64) for c in ("before", "after"))
        yield pa.RecordBatch.from_arrays([_signed(_pair_keys(before, after)), *batch.columns], ["key", *batch.schema.names])


def _sorted(df: DataFrame, *names: str) -> list[np.ndarray]:
    pdf = df.select("key", *names).toPandas()
    keys = pdf["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return [keys[order], *(pdf[n].to_numpy()[order] for n in names)]


@dataclass
class Automaton:
    """The frequent part of the automaton, which tasks have at hand; its states are the root and the tokens.

    P(w) = (c - d) / N for a token that was seen and d V / N for all others together; d = n1 / (n1 + 2 n2).
    P(w | h) = (c(h w) - 3/4) / c(h) on an arc, which every bigram seen LEAST times is, else backoff(h) P(w), where
    backoff(h) gives what the arcs leave over to the tokens that have no arc; so each state's probabilities add up to 1.

    An arc's weight is what it has over the failure path, log10 P(w | h) - log10 (backoff(h) P(w)).  So a text's score is
    the sum over its tokens' unigram and backoff weights and its arcs' weights, wherever each of them is kept.
    """

    n: int
    types: int
    discount: float
    looked_up: np.ndarray  # sorted hashes of frequent tokens
    counts: np.ndarray
    backoff: np.ndarray  # log10 of the failure arc of the token's state, 0 for a state without arcs
    arcs: np.ndarray  # sorted keys of frequent pairs
    weights: np.ndarray  # log10 over the failure path
    bits: np.ndarray  # a bit for the end of each other arc's key; a pair without one is no arc

    def unigram(self, c: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(c))
        p = np.where(c > 0, (c - self.discount) / self.n, self.discount * self.types / self.n)
        return np.log10(p)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + (self.types + 1)))

    def traverse(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(weight, places, keys)``: each token's arc weight, and the pairs that may be arcs that are not at hand.

        Having read a token the automaton stands in that token's state; a row begins in the root.  A pair is named by the
        place of its second token and its key.
        """
        weight, place = np.zeros(len(hashes)), _inner(rows)
        keys = _pair_keys(hashes[place - 1], hashes[place])
        at, hit = found(self.arcs, keys)
        weight[place[hit]] = self.weights[at[hit]]
        place, keys = place[~hit], keys[~hit]
        slot = keys & np.uint64(64 * len(self.bits) - 1)
        maybe = (self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        return weight, place[maybe], keys[maybe]


def _bits(arcs: DataFrame) -> np.ndarray:
    size = min(BITS, max(64, 1 << (8 * arcs.count()).bit_length()))
    slot = F.col("key").bitwiseAND(F.lit(size - 1).cast("long"))
    per_word = arcs.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[per_word.column("word").to_numpy()] = per_word.column("bits").to_numpy().view(np.uint64)
    return out


def train(docs: DataFrame) -> tuple[Automaton, DataFrame, DataFrame]:
    """The frequent part, and all of the automaton: states ``(key, n, backoff)`` and arcs ``(key, n, weight)`` of every row's text."""
    text = docs.select("text")
    counted = text.mapInArrow(_task_counts(lambda d, o: tokens(d, o)[1]), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = written(counted, "lm-tokens")
    total, types, n1, n2 = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    d = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = min(max(d, 0.05), 0.95)
    pairs = text.mapInArrow(_pair_counts, "before long, after long, n long").groupBy("before", "after").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    arcs = written(pairs.join(counted.select(F.col("key").alias("after"), F.col("n").alias("c_after")), "after").select("before", "after", "n", "c_after"), "lm-pairs")
    sums = arcs.groupBy(F.col("before").alias("key")).agg(F.sum(F.col("n") - 0.75).alias("taken"), F.sum(F.col("c_after") - F.lit(d)).alias("covered"))
    left, rest = 1 - F.col("taken") / F.col("n"), 1 - F.col("covered") / F.lit(float(max(total, 1)))
    backoff = F.coalesce(F.log10(F.greatest(left, F.lit(1e-12)) / F.greatest(rest, F.lit(1e-12))), F.lit(0.0))
    states = written(counted.join(sums, "key", "left").select("key", "n", backoff.alias("backoff")), "lm-states")
    of_state = states.select(F.col("key").alias("before"), F.col("n").alias("c"), "backoff")
    weight = F.log10((F.col("n") - 0.75) / F.col("c")) - F.col("backoff") - F.log10((F.col("c_after") - F.lit(d)) / F.lit(float(max(total, 1))))
    weighed = arcs.join(of_state, "before").select("before", "after", "n", weight.alias("weight")).mapInArrow(_keyed, "key long, before long, after long, n long, weight double")
    arcs = written(weighed.select("key", "n", "weight"), "lm-arcs")
    looked_up, counts, backs = _sorted(states.filter(F.col("n") >= F.lit(LOOKED_UP * total)), "n", "backoff")
    frequent, _, weights = _sorted(arcs.filter(F.col("n") >= F.lit(ARC * total)), "n", "weight")
    return Automaton(int(total), int(types), d, looked_up, counts.astype(np.int64), backs.astype(float), frequent, weights.astype(float), _bits(arcs.filter(F.col("n") < F.lit(ARC * total)))), states, arcs


#: A part is a rare token of a document (n times), a rare pair (-n times), or the document's head with all that is settled.
PARTS = "uid long, key long, n long, head struct<doc_id: bigint, held_out: boolean, n: bigint, known: bigint, base: double, score: double>"
_HEAD = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def seventh(docs: DataFrame):
    """crc32 of the id as text, modulo 7; a null id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(column(docs, "doc_id", "string"), F.lit("")), "UTF-8")), F.lit(7))


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    Trained on all rows whose crc32(doc_id) mod 7 is not 2.  Null text is empty: one token, the end.  With nothing to learn
    from, every token has probability 1 under either model.  A row takes part once for each time it stands in the table.

    Every bigram seen LEAST times in training is an arc, whatever the corpus.  Frequent states and arcs are broadcast, in
    tables bounded by frequency (see the constants); all states and arcs stay distributed.  A task sends each rare token and
    each pair of a document that may be another arc once, joins its count and weights, and adds them to the document's.
    """
    held = seventh(docs) == 2
    rows = docs.select(column(docs, "doc_id", "long"), held.alias("held_out"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    model, states, arcs = train(rows.filter(~F.col("held_out")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["uid", "key", "n", "head"]

    def asked(sign, uid, row, keys):
        """One part for each document and key."""
        order = np.lexsort((keys, row))
        r, h = row[order], keys[order]
        first = np.ones(len(order), bool)
        first[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        begin = np.flatnonzero(first)
        many = np.diff(np.append(begin, len(order)))
        return pa.RecordBatch.from_arrays([pa.array(uid[r[begin]]), _signed(h[begin]), pa.array(sign * many), pa.nulls(len(begin), _HEAD)], names)

    def run(batches):
        m = shared.value
        for batch in batches:
            uid, ids, out = batch.column("uid").to_numpy(), batch.column("doc_id"), batch.column("held_out")
            for lo, data, offsets in chunks(batch.column("text")):
                n = len(offsets) - 1
                row, hashes = tokens(data, offsets)
                weight, place, keys = m.traverse(row, hashes)
                at, hit = found(m.looked_up, hashes)
                c = np.where(hit, m.counts[at] if len(m.counts) else 0, 0)
                sure = np.where(hit, 1, 0)
                weight += np.where(hit, m.unigram(c) + (m.backoff[at] if len(m.backoff) else 0.0), 0.0)
                here = slice(lo, lo + n)
                heads = [
                    ids.slice(lo, n), out.slice(lo, n), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row, sure, n).astype(np.int64)),
                    pa.array(np.bincount(row, np.where(hit, m.base(c), 0.0), n)), pa.array(np.bincount(row, weight, n)),
                ]
                spread = _signed(mix(uid[here].view(np.uint64) + np.uint64(77)))
                yield pa.RecordBatch.from_arrays([pa.array(uid[here]), spread, pa.array(np.zeros(n, np.int64)), pa.StructArray.from_arrays(heads, fields=list(_HEAD))], names)
                rare = np.flatnonzero(~hit)
                yield asked(1, uid[here], row[rare], hashes[rare])
                yield asked(-1, uid[here], row[place], keys)

    parts = rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, PARTS)
    # What is broadcast is not asked for.
    told = states.filter(F.col("n") < F.lit(LOOKED_UP * model.n)).select("key", F.lit(False).alias("pair"), F.col("n").alias("c"), F.col("backoff").alias("w"))
    told = told.unionByName(arcs.filter(F.col("n") < F.lit(ARC * model.n)).select("key", F.lit(True).alias("pair"), F.col("n").alias("c"), F.col("weight").alias("w")))
    head, pair = F.col("head").isNotNull(), F.col("n") < 0
    # A pair that is no arc adds nothing to its failure path.
    joined = parts.withColumn("pair", pair).join(told, ["key", "pair"], "left").filter(~pair | F.col("w").isNotNull())
    c, w = F.coalesce("c", F.lit(0)), F.coalesce("w", F.lit(0.0))
    n, types, d = float(max(model.n, 1)), float(model.types), model.discount
    base = F.log10((c + 1) / F.lit(float(model.n + model.types + 1)))
    seen, unseen = F.log10((F.when(c > 0, c).otherwise(1) - F.lit(d)) / F.lit(n)), F.lit(float(np.log10(d * types / n)) if model.n else 0.0)
    own = F.when(c > 0, seen).otherwise(unseen) if model.n else F.lit(0.0)
    parts = joined.select(
        "uid", "head.doc_id", "head.held_out", F.col("head.n").alias("n_tokens"),
        F.when(head, F.col("head.known")).when(~pair & (c > 0), F.col("n")).otherwise(0).alias("known"),
        F.when(head, F.col("head.base")).when(pair, 0.0).otherwise(F.col("n") * base).alias("base"),
        F.when(head, F.col("head.score")).when(pair, -F.col("n") * w).otherwise(F.col("n") * (own + w)).alias("score"),
    )
    summed = parts.groupBy("uid").agg(F.max("n_tokens").alias("n_tokens"), F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
