"""Token counts by a map-side two-tier lookup of pre-tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import Spans, chunks, found
from codeloom.llm.store import documents

#: A pre-token is frequent when it makes up at least this part of all pre-tokens, so there are at most 1 / FREQUENT.
FREQUENT = 2e-6
#: Lengths a worker remembers besides the frequent ones; when full it starts anew.
CACHE = 300_000

_SPACE = 0x20
_state: dict = {}


class Splitter:
    """Cuts text where no piece of a model can reach across.

    Pieces of this kind of model have white space at their beginning only, and characters outside all longer pieces
    stand alone.  Both are read from the vocabulary: ``alone`` holds those ASCII characters; a model that has a piece with
    white space after another character is refused.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without a character map, that keep white space and put it first, are handled")
        kinds = type(spec.pieces[0])
        if any(p.type in (kinds.USER_DEFINED,) for p in spec.pieces):
            raise ValueError("user-defined pieces are not handled")
        self.prefix = norm.add_dummy_prefix
        longer = [p.piece for p in spec.pieces if p.type == kinds.NORMAL and len(p.piece) > 1]
        if any("▁" in p.lstrip("▁") for p in longer):
            raise ValueError("a piece has white space inside")
        inside = set("".join(longer))
        self.alone = np.array([chr(c) not in inside and c != _SPACE for c in range(128)] + [False] * 128)

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, start, end)`` of the pre-tokens, which together are all bytes of the rows."""
        if not len(data):
            return (np.zeros(0, np.int64),) * 3
        alone, space = self.alone[data], data == _SPACE
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        begin = begin[:-1]
        begin[1:] |= space[1:] & ~space[:-1]
        # A mark of white space in the text itself (U+2581) joins runs of spaces, so no cut is made behind it.
        mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) + 3 if len(data) > 2 else np.zeros(0, np.int64)
        begin[mark[mark < len(data)]] &= np.isin(mark[mark < len(data)], offsets)
        begin |= alone
        begin[1:] |= alone[:-1]
        starts = np.flatnonzero(begin)
        return np.searchsorted(offsets, starts, "right") - 1, starts, np.append(starts[1:], len(data))


class Pretokens:
    """The pre-tokens of one chunk and the distinct ones among them.

    Whether a pre-token begins its text matters (the dummy prefix), so that is part of its key.
    """

    def __init__(self, splitter: Splitter, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.rows, self.starts, self.ends = splitter.spans(data, offsets)
        self.head = self.starts == offsets[self.rows] if len(self.starts) else np.zeros(0, bool)
        keys = Spans(data).hashes(self.starts, self.ends) ^ (self.head.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.keys, self.first, self.which = np.unique(keys, return_index=True, return_inverse=True)

    def text(self, i: int) -> str:
        at = self.first[i]
        return self.data[self.starts[at] : self.ends[at]].tobytes().decode("utf-8", "replace")


def _load(model: bytes) -> tuple:
    if _state.get("model") != model:
        import sentencepiece

        encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        lone = len(encoder.encode("\n")) if encoder.encode("\n") else 0
        _state.update(model=model, encoder=encoder, lone=lone, cache={}, splitter=Splitter(model))
    return _state["encoder"], _state["lone"], _state["cache"], _state["splitter"]


def frequent_pretokens(docs: DataFrame, model: bytes, share: float = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys and lengths of the frequent pre-tokens, sorted by key: at most 1 / ``share`` of them.

    Every text is counted.  A pre-token with that share of all has it in at least one task, so a task sends only those
    that reach it there; the driver gets at most 1 / ``share`` rows, the most frequent.
    """

    def count(batches):
        encoder, lone, cache, splitter = _load(model)
        keys, counts, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        total = 0
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                p = Pretokens(splitter, data, offsets)
                total += len(p.which)
                both = np.concatenate([keys, p.keys])
                keys, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, np.bincount(p.which, minlength=len(p.keys))]), len(keys)).astype(np.int64)
                many = np.bincount(p.which, minlength=len(p.keys)) >= max(2, share * len(p.which))
                for i in np.flatnonzero(many):
                    if int(p.keys[i]) not in texts:
                        texts[int(p.keys[i])] = _length(encoder, lone, p.text(i), bool(p.head[p.first[i]]))
        often = counts >= max(2, share * total)
        rows = [(int(k), int(c), texts[int(k)]) for k, c in zip(keys[often], counts[often]) if int(k) in texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["key", "n", "length"]
        )

    seen = docs.select("text").mapInArrow(count, "key long, n long, length long")
    best = seen.groupBy("key").agg(F.sum("n").alias("n"), F.first("length").alias("length")).orderBy(F.desc("n"), "key").limit(int(1 / share)).select("key", "length").toPandas()
    keys = best["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], best["length"].to_numpy(np.int32)[order]


def _length(encoder, lone: int, text: str, head: bool) -> int:
    return len(encoder.encode(text)) if head else len(encoder.encode("\n" + text)) - lone


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, share: float = FREQUENT, cache_size: int = CACHE) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``, as the library's encoder counts.

    Null text is empty and has no tokens.  The frequent pre-tokens' lengths are broadcast (at most 1 / ``share`` of them);
    others are encoded once per chunk and remembered by the worker.  No pre-token is shuffled on the way to a count.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    Splitter(model)
    rows = documents(docs)
    context = docs.sparkSession.sparkContext
    table = context.broadcast(frequent_pretokens(rows, model, share))

    def count(batches):
        encoder, lone, cache, splitter = _load(model)
        keys, lengths = table.value
        for batch in batches:
            sizes, totals = [], []
            for _, data, offsets in chunks(batch.column("text")):
                p = Pretokens(splitter, data, offsets)
                at, hit = found(keys, p.keys)
                each = np.where(hit, lengths[at] if len(lengths) else 0, 0).astype(np.int64)
                for i in np.flatnonzero(~hit):
                    key = int(p.keys[i])
                    n = cache.get(key)
                    if n is None:
                        if len(cache) >= cache_size:
                            cache.clear()
                        n = cache[key] = _length(encoder, lone, p.text(i), bool(p.head[p.first[i]]))
                    each[i] = n
                totals.append(np.bincount(p.rows, each[p.which], len(offsets) - 1).astype(np.int64))
                sizes.append(np.diff(offsets))
            if not totals:
                continue
            n = np.concatenate(totals)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(sizes)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, COUNTS)
