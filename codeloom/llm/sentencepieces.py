"""SentencePiece encoding and decoding by a weighted finite-state transducer."""

from __future__ import annotations

from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import chunks, lists, ragged
from codeloom.llm.store import column, documents
from codeloom.llm.token_counts import Pretokens, Splitter

#: Paths and pairs a worker remembers; when full it starts anew.
CACHE, PAIRS = 200_000, 400_000
MARK = "▁"

_state: dict = {}


class Transducer:
    """Normaliser, pieces and byte fallback of a model as arcs; a text's encoding is the shortest path through them.

    The normaliser arcs write the space mark for a space and a mark in front of the text.  A piece arc reads a piece and
    writes its id; a fallback arc reads one character that is no piece and writes the ids of its bytes.  Weights are
    negated scores, added along a path and compared by the smaller (the tropical semiring).

    For a model of merges a second automaton restricts what may follow what: piece b may follow piece a if merging a + b
    from single characters ends in a, b; other arcs weigh infinity.  A sequence in which each neighbour pair passes is
    the library's result and the only such path, because the first merge across a border would happen in the pair alone
    as well.  The prefix that ends in a node then has one path too, so the last piece is all that a node has to keep.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        kinds = type(spec.pieces[0])
        if spec.trainer_spec.model_type not in (1, 2) or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("only models of merges or of a unigram language model, without user-defined or unused pieces, are handled")
        self.splitter = Splitter(model)
        self.merges = spec.trainer_spec.model_type == 2
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        self.pieces = {p.piece: (i, -p.score) for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.fallback = max((w for _, w in self.pieces.values()), default=0.0) + 10
        self.out = [b"" if p.type == kinds.CONTROL else " ⁇ ".encode() if p.type == kinds.UNKNOWN else bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else p.piece.replace(MARK, " ").encode() for p in spec.pieces]
        self.text = [p.piece for p in spec.pieces]
        # A trie of the reversed pieces as a table: what is read so far, backwards → (id, weight, whether a longer piece ends so).
        tails = {p[i:] for p in self.pieces for i in range(1, len(p))}
        self.arcs = {**dict.fromkeys(tails), **{p: (i, w, p in tails) for p, (i, w) in self.pieces.items()}}
        # Keys are two arcs in one number, which takes half the memory of a pair.
        self.follows: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, best score and leftmost first, until no neighbours form a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = inf, -1
            for i in range(len(parts) - 1):
                arc = self.pieces.get(parts[i] + parts[i + 1])
                if arc is not None and arc[1] < best:
                    best, at = arc[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Arc b after arc a; arcs are ids, or -1 - code point for a fallback, and 0 (never an arc) stands for the beginning."""
        first, second = self.text_of(a), self.text_of(b)
        return self.merged(first + second) == ([first, second] if first else [second])

    def text_of(self, arc: int) -> str:
        return chr(-1 - arc) if arc < 0 else self.text[arc] if arc else ""

    def shortest_paths(self, texts: list[str]) -> list[list[int]]:
        """The ids of normalised texts.  In sorted order a text goes on from the nodes it shares with the one before."""
        arcs, merges, fallback = self.arcs, self.merges, self.fallback
        weight, last, back = [0.0], [0], [0]
        before, out = "", []
        for text in texts:
            shared, most, n = 0, min(len(before), len(text)), len(text)
            while shared < most and before[shared] == text[shared]:
                shared += 1
            del weight[shared + 1 :], last[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, n + 1):
                best, arc_in, origin = inf, 0, 0
                for begin in range(end - 1, -1, -1):
                    arc = arcs.get(text[begin:end], False)
                    if not arc:
                        if begin == end - 1:
                            arc = (-1 - ord(text[begin]), fallback, arc is None)
                        elif arc is None:
                            continue
                        else:
                            break
                    which, cost, more = arc
                    cost += weight[begin]
                    if cost < best:
                        if merges:
                            first = last[begin]
                            pair = (first << 32) + which
                            may = self.follows.get(pair)
                            if may is None:
                                if len(self.follows) >= PAIRS:
                                    self.follows.clear()
                                may = self.follows[pair] = self.may_follow(first, which)
                            if may:
                                # Under merges a node has one path, so it is settled.
                                best, arc_in, origin = cost, which, begin
                                break
                        else:
                            best, arc_in, origin = cost, which, begin
                    if not more:
                        break
                weight.append(best)
                last.append(arc_in)
                back.append(origin)
            ids: list[int] = []
            while n > 0:
                if last[n] > 0:
                    ids.append(last[n])
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in reversed(chr(-1 - last[n]).encode("utf-8")))
                else:
                    ids.append(self.unknown)
                n = back[n]
            out.append(ids[::-1])
            before = text
        return out

    def normalise(self, text: str, head: bool = True) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if head and self.prefix and text else text

    def encode(self, data: np.ndarray, offsets: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ids per row)`` of a chunk; each distinct stretch between sure borders is composed once."""
        p = Pretokens(self.splitter, data, offsets)
        keys = p.keys.tolist()
        if len(cache) + len(keys) > CACHE:
            cache.clear()
        misses = sorted((self.normalise(p.text(i), bool(p.head[p.first[i]])), key) for i, key in enumerate(keys) if key not in cache)
        for (_, key), ids in zip(misses, self.shortest_paths([text for text, _ in misses])):
            cache[key] = np.array(ids, np.int32).tobytes()
        found = [cache[key] for key in keys]
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        if not len(sizes):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        flat, begins, each = np.frombuffer(b"".join(found), np.int32), np.cumsum(sizes) - sizes, sizes[p.which]
        return flat[np.repeat(begins[p.which], each) + ragged(each)], np.bincount(p.rows, each, len(offsets) - 1).astype(np.int64)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The text of each row, in UTF-8; bytes that are no UTF-8 become the replacement character."""
        table = _state.setdefault("table", {})
        if table.get("of") is not self:
            length = np.array([len(x) for x in self.out], np.int64)
            table.update(of=self, flat=np.frombuffer(b"".join(self.out), np.uint8), length=length, begin=np.cumsum(length) - length)
        each = table["length"][ids]
        flat = table["flat"][np.repeat(table["begin"][ids], each) + ragged(each)]
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])]
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            text = flat[a:b].tobytes()
            out.append(text[1:] if self.prefix and text[:1] == b" " else text)
        return out


def _load(model: bytes) -> tuple[Transducer, dict]:
    if _state.get("model") != model:
        _state.update(model=model, fst=Transducer(model), paths={})
    return _state["fst"], _state["paths"]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read()
    Transducer(model)
    return model


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids array<int>, n_tokens, round_trip)``, one row per row of ``docs``; null text is empty, which has no ids.

    ``round_trip`` says whether decoding gives the text back.  It is false only where the text has the mark U+2581 itself,
    which decodes to a space.  Work is map-side; a worker keeps a bounded cache of stretches, so tasks need no shuffle.
    """
    model = _read(model_path)

    def run(batches):
        fst, paths = _load(model)
        for batch in batches:
            for lo, data, offsets in chunks(batch.column("text")):
                ids, sizes = fst.encode(data, offsets, paths)
                texts = fst.decode(ids, sizes)
                raw = data.tobytes()
                same = [raw[a:b] == x for a, b, x in zip(offsets[:-1].tolist(), offsets[1:].tolist(), texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, len(sizes)), lists(ids, sizes, pa.int32()), pa.array(sizes), pa.array(same)], ["doc_id", "ids", "n_tokens", "round_trip"]
                )

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` → ``(doc_id, text)``; null ids are empty, an id outside the model is an error."""
    model = _read(model_path)

    def run(batches):
        fst, _ = _load(model)
        for batch in batches:
            col = batch.column("ids")
            ids, sizes = col.flatten().to_numpy(zero_copy_only=False), np.diff(np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in col])])).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(fst.out)):
                raise ValueError("an id is not in the model")
            texts = [x.decode("utf-8", "replace") for x in fst.decode(ids, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    ids = F.filter(F.coalesce(column(rows, "ids", "array<int>"), F.array().cast("array<int>")), lambda x: x.isNotNull())
    return rows.select(column(rows, "doc_id", "long"), ids.alias("ids")).mapInArrow(run, "doc_id long, text string")
