"""Dedup of repeated passages: paragraph MinHash, banded, verified and clustered; exact pieces of long paragraphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import Spans, chunks, found, lists, lowered, mix, ragged, word_spans
from codeloom.llm.linking import colliding, link
from codeloom.llm.near_dedup import linked
from codeloom.llm.store import column, written

#: Words of a shingle, and the similarity in percent that links two paragraphs.
WIDTH, PERCENT = 5, 80
#: One MinHash value is a band.  At similarity 0.8 a pair shares one of BANDS with a chance of 1 - 0.2^BANDS = 0.998, at 0.9
#: 0.9999; different paragraphs hardly ever share a five-word shingle, so longer bands would only cost recall.
BANDS = 4
#: Stretches of fewer words are joined with neighbours that are as short; alone they are not looked up, but go along beside
#: removed ones.
PARAGRAPH = 6
#: A sentence of fewer words stays with the one behind it.
SENTENCE = 4
#: Longer paragraphs also have pieces, which are looked up as they are: they are cut before words whose hash, with the next word's, is the lowest of REACH words on either side; so a
#: piece has at least REACH words and 2 REACH + 1 on average, and cuts fall alike wherever a passage stands.
LONGEST, REACH = 20, PARAGRAPH
#: Words that repeated paragraphs standing together must have before they are removed.
PASSAGE = 30
_STEP = np.uint64(0x9DDFEA08EB382D69)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_NO_ID = (1 << 63) - 1


class Paragraphs:
    """The paragraphs of a chunk: stretches of words between line feeds and ends (. ! ?) of sentences that are not short, or
    several short stretches, of lines or sentences, that stand together; and the pieces of long ones, cut where their words
    say.  ``first`` to ``hash`` are of pieces, ``whole`` is the paragraph of each piece, and ``p_*`` are of paragraphs; a
    paragraph that is not cut is its own piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        small = lowered(data)
        self.rows, self.starts, self.ends = word_spans(small, offsets)
        self.words = Spans(small).hashes(self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        n = len(self.starts)
        if not n:
            self.first = self.last = self.row = self.size = self.whole = self.p_first = self.p_row = self.p_size = np.zeros(0, np.int64)
            self.hash = self.p_hash = np.zeros(0, np.uint64)
            return
        stop = np.isin(data[self.ends - 1], np.frombuffer(b".!?", np.uint8))
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        line = np.ones(n, bool)
        line[1:] = (self.rows[1:] != self.rows[:-1]) | (feeds[self.starts[1:]] != feeds[self.ends[:-1]])
        sentence = line.copy()
        sentence[1:] |= stop[:-1]
        begins = np.flatnonzero(sentence)
        # Whether a stretch ends a paragraph depends on nothing but itself and the next, so a passage is cut alike wherever it
        # stands.
        size = np.diff(np.append(begins, n))
        tiny = size < PARAGRAPH
        next_row = self.rows[begins[1:]] != self.rows[begins[1:] - 1]
        sentence[begins[1:][~next_row & (((size[:-1] < SENTENCE) & ~line[begins[1:]]) | (tiny[:-1] & tiny[1:]))]] = False
        self.p_first = np.flatnonzero(sentence)
        self.p_row, self.p_size = self.rows[self.p_first], np.diff(np.append(self.p_first, n))
        self.p_hash = self._hashes(self.p_first, self.p_size)
        sentence[self._cuts(self.p_first)] = True
        self.first = np.flatnonzero(sentence)
        self.last = np.append(self.first[1:], n)
        self.row, self.size = self.rows[self.first], self.last - self.first
        self.whole = np.searchsorted(self.p_first, self.first, "right") - 1
        self.hash = self._hashes(self.first, self.size)

    def _hashes(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        # Words are scrambled with their place, so the sum is a hash of their order.
        return mix(np.add.reduceat(mix(self.words + ragged(size).astype(np.uint64) * _STEP), first) + size.astype(np.uint64))

    @property
    def cut(self) -> np.ndarray:
        """The paragraphs that have several pieces."""
        return np.flatnonzero(np.bincount(self.whole, minlength=len(self.p_first)) > 1)

    def _cuts(self, first: np.ndarray) -> np.ndarray:
        """The words that pieces of long paragraphs begin with."""
        n = len(self.words)
        size = np.diff(np.append(first, n))
        place, whole = ragged(size), np.repeat(size, size)
        at = np.flatnonzero((whole > LONGEST) & (place >= REACH) & (whole - place > REACH))
        # The last word of a paragraph is not looked at, so the next word is one of the same paragraph.
        h = mix(mix(self.words) + np.append(self.words[1:], np.uint64(0)))
        lowest = np.ones(len(at), bool)
        for k in range(1, REACH):
            lowest &= (h[at] < h[at - k]) & (h[at] <= h[at + k])
        lowest &= h[at] < h[at - REACH]
        return at[lowest]

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(hashes, number per paragraph)`` of the given paragraphs; one with fewer words is a shingle itself."""
        many = np.maximum(self.p_size[which] - WIDTH + 1, 1)
        at = np.repeat(self.p_first[which], many) + ragged(many)
        left = np.repeat(self.p_first[which] + self.p_size[which], many) - at
        out = mix(self.words[at] + np.uint64(1))
        for k in range(1, WIDTH):
            on = left > k
            out[on] = mix(out[on] * _STEP + self.words[at[on] + k])
        return out, many


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _batches(kind: str):
    """Map-side rows ``(key, node)``: of ``kind`` "place" a document's distinct paragraphs and pieces, of "band" paragraphs' bands."""

    def run(batches):
        for batch in batches:
            ids = batch.column("d").to_numpy()
            for lo, data, offsets in chunks(batch.column("text")):
                p = Paragraphs(data, offsets)
                if kind == "place":
                    cut, which = p.cut, np.flatnonzero(p.size >= PARAGRAPH)
                    hashes, rows = np.concatenate([p.hash[which], p.p_hash[cut]]), np.concatenate([p.row[which], p.p_row[cut]])
                    # A hash that repeats in its document is one row; the document is mixed in to tell the pairs apart.
                    _, one = np.unique(hashes ^ mix(rows.astype(np.uint64) + np.uint64(1)), return_index=True)
                    key, node = hashes[one], ids[lo : lo + len(offsets) - 1][rows[one]]
                else:
                    # Fewer than WIDTH + 3 words are fewer than four shingles: similar by 0.8 only if equal.
                    _, which = np.unique(p.p_hash, return_index=True)
                    which = which[p.p_size[which] >= WIDTH + 3]
                    if not len(which):
                        continue
                    sets, many = p.shingles(which)
                    begin = np.cumsum(many) - many
                    key = np.concatenate([mix(np.minimum.reduceat(mix(sets ^ b), begin) + b) for b in _BAND])
                    node = np.tile(p.p_hash[which], BANDS).view(np.int64)
                yield pa.RecordBatch.from_arrays([_signed(key), pa.array(node)], ["key", "node"])

    return run


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, s array<long>)``: the distinct shingles of ``wanted(node, d)``, from the texts of those documents."""
    per_doc = wanted.groupBy("d").agg(F.collect_set("node").alias("nodes"))
    texts = docs.join(per_doc, "d")

    def run(batches):
        for batch in batches:
            asked = batch.column("nodes")
            for lo, data, offsets in chunks(batch.column("text")):
                p = Paragraphs(data, offsets)
                for i in range(len(offsets) - 1):
                    want = np.sort(asked[lo + i].values.to_numpy())
                    own = np.arange(*np.searchsorted(p.p_row, [i, i + 1]))
                    own = own[found(want, p.p_hash[own].view(np.int64))[1]]
                    own = own[np.unique(p.p_hash[own], return_index=True)[1]]
                    if not len(own):
                        continue
                    sets, many = p.shingles(own)
                    parts = [np.unique(x) for x in np.split(sets, np.cumsum(many)[:-1])]
                    yield pa.RecordBatch.from_arrays([_signed(p.p_hash[own]), lists(np.concatenate(parts).view(np.int64), np.array([len(x) for x in parts]), pa.int64())], ["node", "s"])

    return texts.select("nodes", "text").mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(column(docs, "doc_id", "long"), F.lit(_NO_ID)).alias("d"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """``(d, node, root, low)``: the paragraphs of each document ``d`` that stand, alike or similar, in another one too.

    root names the class of similar paragraphs, low is the first document (smallest id) that has one of the class.
    """
    rows = _rows(docs)
    places = rows.mapInArrow(_batches("place"), "key long, node long").select(F.col("key").alias("node"), F.col("node").alias("d"))
    # Copies of a paragraph are combined map-side: a very common line costs a row per task.
    lows = places.groupBy("node").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    bands = colliding(rows.mapInArrow(_batches("band"), "key long, node long"), "passage")
    lows = written(lows, "passage-lows")
    met = written(lows.join(bands.select("node").distinct(), "node").select("node", F.col("low").alias("d")), "passage-met")
    sets = written(_sets(rows, met), "passage-sets")
    classes = link(bands, lambda pairs: linked(pairs, sets, PERCENT), lambda some: sets.join(some, "node"), PERCENT, "passage")
    rooted = lows.join(classes, "node", "left").filter("low != high or root is not null").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("root").agg(F.min("low").alias("low"))
    told = written(rooted.select("node", "root").join(first, "root"), "passage-classes")
    return places.join(told, "node").select("d", "node", "root", "low")


FLAGGED = "doc_id long, n_paragraphs long, n_repeated long, n_removed long, words_removed long, removed array<int>, classes array<long>"


def _grouped(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """The distinct values of each of ``n`` rows, sorted, as a list column."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return lists(values[new], np.bincount(rows[new], minlength=n), kind)


def _flag(texts: bool):
    """What is removed from the rows ``(d, text, nodes, roots, lows)``; the documents of a chunk are looked at together."""

    def part(ids: np.ndarray, none: pa.Array, told: list[pa.Array], data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        p = Paragraphs(data, offsets)
        n = len(ids)
        many = pc.fill_null(pc.list_value_length(told[0]), 0).to_numpy()
        of = np.repeat(np.arange(n), many).astype(np.uint64)
        node, root, low = (t.flatten().to_numpy() for t in told)
        # A hash of document and paragraph: what is told of a document holds for its own paragraphs only.
        place = mix(of + np.uint64(1)) + node.view(np.uint64)
        order = np.argsort(place)

        def classes(row: np.ndarray, hashes: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Class, whether an earlier document has it or an earlier place in this one, and whether there is another at all."""
            at, hit = found(place[order], mix(row.astype(np.uint64) + np.uint64(1)) + hashes)
            hit &= use
            own = hashes.view(np.int64)
            if len(node):
                own, before = np.where(hit, root[order][at], own), np.where(hit, low[order][at], ids[row])
            else:
                before = ids[row]
            _, first = np.unique(mix(row.astype(np.uint64) + np.uint64(1)) + own.view(np.uint64), return_index=True)
            later = np.ones(len(row), bool)
            later[first] = False
            return own, use & ((hit & (before < ids[row])) | later), hit | (use & later)

        p_class, p_repeat, p_known = classes(p.p_row, p.p_hash, p.p_size >= PARAGRAPH)
        long = p.size >= PARAGRAPH
        own, repeat, known = classes(p.row, p.hash, long)
        # A paragraph that is repeated as a whole is so in all its pieces.
        by_whole = p_repeat[p.whole]
        solid = np.flatnonzero(long | by_whole)
        flags = (repeat | by_whole)[solid]
        # Short paragraphs go along between repeated ones; a run needs PASSAGE words in its long ones.
        new = np.ones(len(solid), bool)
        new[1:] = (flags[1:] != flags[:-1]) | (p.row[solid[1:]] != p.row[solid[:-1]])
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        wide = flags[begin] & (np.bincount(run, p.size[solid], len(begin)) >= PASSAGE) if len(solid) else np.zeros(0, bool)
        edge = np.zeros(len(p.size) + 1, np.int64)
        end = np.append(begin[1:], len(solid))
        edge[solid[begin[wide]]] += 1
        edge[solid[end[wide] - 1] + 1] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        # Places of paragraphs count from 0 in each document.
        at = np.arange(len(p.p_row)) - np.searchsorted(p.p_row, p.p_row)
        touched = np.unique(p.whole[gone])
        repeated = p_known.copy()
        repeated[p.whole[known]] = True
        named = gone & (long | by_whole)
        shown = np.where(by_whole, p_class[p.whole], own)
        count = lambda which, weights=None: pa.array(np.bincount(which, weights, n).astype(np.int64))
        out = {
            "doc_id": none, "n_paragraphs": count(p.p_row), "n_repeated": count(p.p_row[repeated]), "n_removed": count(p.p_row[touched]),
            "words_removed": count(p.row[gone], p.size[gone]), "removed": _grouped(p.p_row[touched], at[touched].astype(np.int32), n, pa.int32()),
            "classes": _grouped(p.row[named], shown[named], n, pa.int64()),
        }
        if texts:
            # From the first word of what goes to the next word, or to the end of the document.
            nexts = np.append(p.starts[p.first[1:]], len(data)) if len(p.first) else np.zeros(0, np.int64)
            final = np.append(p.row[1:] != p.row[:-1], True) if len(p.row) else np.zeros(0, bool)
            nexts = np.where(final, offsets[p.row + 1], nexts)
            bytes_ = np.zeros(len(data) + 1, np.int64)
            np.add.at(bytes_, p.starts[p.first[gone]], 1)
            np.add.at(bytes_, nexts[gone], -1)
            keep = np.cumsum(bytes_[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(keep)])[offsets]
            out["kept_text"] = pa.LargeStringArray.from_buffers(n, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[keep])).cast(pa.string())
        return pa.RecordBatch.from_pydict(out)

    def run(batches):
        for batch in batches:
            ids = batch.column("d").to_numpy()
            shown = pc.if_else(pc.equal(batch.column("d"), _NO_ID), pa.scalar(None, pa.int64()), batch.column("d"))
            for lo, data, offsets in chunks(batch.column("text")):
                n = len(offsets) - 1
                yield part(ids[lo : lo + n], shown.slice(lo, n), [batch.column(c).slice(lo, n) for c in ("nodes", "roots", "lows")], data, offsets)

    return run


def dedup_passages(docs: DataFrame, texts: bool = True) -> DataFrame:
    """``(doc_id, n_paragraphs, n_repeated, n_removed, words_removed, removed, classes, kept_text)``, one row per row of ``docs``.

    A paragraph is a stretch of words between line feeds and ends of sentences of at least SENTENCE words, compared without
    regard to A-Z case and white space; stretches of fewer than PARAGRAPH words that stand together are one.  Paragraphs are
    alike if equal, or if their sets of five-word shingles have a Jaccard similarity of at least 0.8; components of alike
    paragraphs are classes.  A paragraph of more than LONGEST words also has pieces, cut at borders that its words decide,
    which are alike if equal; so a passage that begins or ends within a paragraph is found but for the pieces at its edges.

    A paragraph or piece is repeated if an earlier document, or an earlier place in its own, has its class; it is removed
    where repeated ones stand together with at least PASSAGE words.  ``n_paragraphs``, ``n_repeated`` (some other place has
    its class or that of a piece) and ``n_removed`` (all or some of its words go) count paragraphs; ``removed`` are the places
    of the latter from 0, ``classes`` the classes of what goes.  ``kept_text`` comes with ``texts`` only.

    Words are parted by ASCII white space, so text without it (Chinese, Japanese) has too few words to be looked up.
    Null text is empty; rows that share an id count as one document; null ids come last and count as one.
    """
    rows = _rows(docs)
    told = repeated_paragraphs(docs).distinct().groupBy("d").agg(F.collect_list(F.struct("node", "root", "low")).alias("x"))
    joined = rows.join(told, "d", "left").select("d", "text", F.col("x.node").alias("nodes"), F.col("x.root").alias("roots"), F.col("x.low").alias("lows"))
    return joined.mapInArrow(_flag(texts), FLAGGED + (", kept_text string" if texts else ""))
