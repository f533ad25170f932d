"""Substring deduplication with repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window over
it has a word sequence that also starts earlier (smaller doc_id, or same document and
earlier start).

1. Anchors.  Each window stands for the phrase of ``PHRASE`` words in it with the smallest
   hash, so equal windows have equal anchors and neighbouring windows share one: a
   seventh of all positions is enough to look at.  Blocks of documents send
   their anchors to shards, which confirm those found twice or more.
2. Automata.  The confirmed phrases are dealt to the blocks that hold them, and every block is an automaton
   shard: it compiles its phrases, word by word, into Aho-Corasick automata (``AUTOMATON`` phrases
   each) and streams all its documents through them.  A document so meets every phrase that it can hold,
   while the work grows with the corpus and not with its square, as it would if all documents went through
   the phrases of all blocks.  The occurrences found are written; the later steps read them and nothing else,
   and a window is a candidate if its anchor is among them.
3. Order.  The candidates' window hashes go to shards with the block's smallest doc_id;
   a shard tells each block which of them are the corpus's first.  All other
   occurrences are removed.

Windows compare by 96 bits of hash of their words.  A null text has no words.  A null doc_id counts
as larger than any other.  Rows that repeat a doc_id are one document in order:
equal first windows of them are all kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.llm import blocks, store
from siteline.llm import text as T

WINDOW = 20
PHRASE = 8
#: Phrases in one automaton.
AUTOMATON = 100_000
#: Characters that spell a word in an automaton.
DIGITS = 2
_MARK = 0x100
_SALT = np.uint64(0x8CB92BA72F3D8DD7)
_SPAN = WINDOW - PHRASE + 1
_TOP = np.uint64((1 << 64) - 1)
_LAST = np.iinfo(np.int64).max


class Slice:
    """A slice's words, its phrase hashes, and each window's smallest."""

    def __init__(self, w: T.Words):
        self.w = w
        self.windows = w.gram_starts(WINDOW)
        self.phrases = T.grams(w.hashes, PHRASE)
        lowest = T.sliding(self.phrases, _SPAN, np.minimum)
        self.lowest = lowest[self.windows] if len(self.windows) else lowest[:0]

    def anchors(self) -> np.ndarray:
        """Positions of phrases that are the smallest of a window over them."""
        if not len(self.windows):
            return np.empty(0, np.int64)
        own = np.zeros(len(self.phrases) + _SPAN - 1, np.uint64)
        own[self.windows + _SPAN - 1] = self.lowest
        return np.flatnonzero(T.sliding(own, _SPAN, np.maximum) == self.phrases)

    def candidates(self, hits: np.ndarray) -> np.ndarray:
        """Which windows have their anchor among the phrases found at ``hits``."""
        if not len(self.windows):
            return np.empty(0, bool)
        own = np.full(len(self.phrases), _TOP)
        own[hits] = self.phrases[hits]
        return T.sliding(own, _SPAN, np.minimum)[self.windows] == self.lowest


def slices(texts: pa.Array) -> list[Slice]:
    return [Slice(w) for w in T.words(texts)]


def anchor_counts(parts: list[Slice]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted anchors of a block and how often each occurs."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *(s.phrases[s.anchors()] for s in parts)]), return_counts=True)


def occurrences(parts: list[Slice], confirmed: np.ndarray) -> list[np.ndarray]:
    """Where, in each slice, the confirmed phrases (sorted hashes, each an anchor of this block) occur, found by automata."""
    keys, rows = [np.empty(0, np.uint64)], [np.empty((0, PHRASE), np.uint64)]
    for s in parts:
        at = s.anchors()
        place = np.searchsorted(confirmed, s.phrases[at])
        place[place == len(confirmed)] = 0
        at = at[confirmed[place] == s.phrases[at]] if len(confirmed) else at[:0]
        keys.append(s.phrases[at])
        rows.append(s.w.hashes[at[:, None] + np.arange(PHRASE)])
    _, first = np.unique(np.concatenate(keys), return_index=True)
    phrases = np.concatenate(rows)[first]
    found: list[list[np.ndarray]] = [[] for _ in parts]
    for lo in range(0, len(phrases), AUTOMATON):
        some = phrases[lo : lo + AUTOMATON]
        alphabet, ids = np.unique(some, return_inverse=True)
        spelt = _spelling(len(alphabet))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        joined, step = spelt[ids.ravel()].tobytes().decode("utf-32-le"), PHRASE * DIGITS
        for k in range(0, len(joined), step):
            automaton.add_word(joined[k : k + step], k)
        automaton.make_automaton()
        for out, s in zip(found, parts, strict=True):
            place = np.searchsorted(alphabet, s.w.hashes)
            place[place == len(alphabet)] = 0
            place = np.where(alphabet[place] == s.w.hashes, place, len(alphabet))
            at = np.arange(len(place)) + s.w.doc
            text = np.full((len(place) + s.w.n_docs, DIGITS), _MARK, "<u4")  # a mark ends each document
            text[at] = spelt[place]
            ends = np.fromiter((e for e, _ in automaton.iter(text.tobytes().decode("utf-32-le"))), np.int64) // DIGITS
            out.append(np.searchsorted(at, ends) - PHRASE + 1)
    return [np.unique(np.concatenate([np.empty(0, np.int64), *out])) for out in found]


def _spelling(n: int) -> np.ndarray:
    """``DIGITS`` characters for each of ``n`` words, and marks for any other word.

    Each place has characters of its own, so that nothing is found across words, and few, as
    the automaton looks through a state's successors one by one.
    """
    base = max(2, int(np.ceil(n ** (1 / DIGITS))) + 1)
    out = np.full((n + 1, DIGITS), _MARK, "<u4")
    for k in range(DIGITS):
        out[:n, k] = _MARK + 1 + k * base + np.arange(n) // base**k % base
    return out


def _doc_ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)


def window_hashes(s: Slice, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, of 64 and 32 bits, of the windows at some places."""
    check = T.grams(T.mix(s.w.hashes ^ _SALT), WINDOW)[at] >> np.uint64(32)
    return T.grams(s.w.hashes, WINDOW)[at], check.astype(np.uint32)


def candidate_windows(parts: list[Slice], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The two hashes, row of the block and start (a word of the document) of each candidate window."""
    keys, checks, rows, starts = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s, hits in zip(parts, places, strict=True):
        at = s.windows[s.candidates(hits)]
        if len(at):
            doc = s.w.doc[at]
            key, check = window_hashes(s, at)
            keys.append(key)
            checks.append(check)
            rows.append(doc + s.w.first)
            starts.append(at - s.w.bounds[doc])
    return np.concatenate(keys), np.concatenate(checks), np.concatenate(rows), np.concatenate(starts)


def opening(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which rows of sorted windows differ from the row before."""
    return np.append(True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]))[: len(keys)]


def pack_places(parts: list[Slice], places: list[np.ndarray]) -> tuple[bytes, int]:
    """A bit for each word of a block: whether an occurrence starts there."""
    size = [len(s.w.hashes) for s in parts]
    bits = np.zeros(sum(size), bool)
    for low, at in zip(np.cumsum([0, *size]), places, strict=False):
        bits[low + at] = True
    return np.packbits(bits).tobytes(), len(bits)


def unpack_places(parts: list[Slice], raw: bytes) -> list[np.ndarray]:
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
    edges = np.cumsum([0, *(len(s.w.hashes) for s in parts)])
    return [np.flatnonzero(bits[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


_FLAGS = "block int, shard int, flags binary, n int"


def _flag_rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32()]
    cols = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["block", "shard", "flags", "n"])


def _flags(table: pa.Table) -> np.ndarray:
    rows = sorted(table.select(["shard", "flags", "n"]).to_pylist(), key=lambda r: r["shard"])
    return np.concatenate([np.empty(0, bool), *(np.unpackbits(np.frombuffer(r["flags"], np.uint8))[: r["n"]].astype(bool) for r in rows)])


def _answer(rows: list[dict], keys: list[np.ndarray], flags: np.ndarray) -> pa.Table:
    out, at = [], 0
    for r, k in zip(rows, keys, strict=True):
        out.append((r["block"], r["shard"], np.packbits(flags[at : at + len(k)]).tobytes(), len(k)))
        at += len(k)
    return _flag_rows(out)


def _confirm(dealt: DataFrame, n_shards: int) -> DataFrame:
    """For each block, which of its anchors occur twice or more in the corpus."""

    def send(table: pa.Table) -> pa.Table:
        keys, counts = anchor_counts(slices(blocks.opened(table).column("text")))
        block = table.column("block")[0].as_py()
        rows = [(shard, block, blocks.pack_keys(keys[at]), blocks.pack(counts[at])) for shard, at in blocks.cuts(keys, n_shards)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, [pa.int32()] * 2 + [pa.binary()] * 2, strict=True)], ["shard", "block", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [blocks.unpack_keys(r["keys"]) for r in rows]
        counts = np.concatenate([blocks.unpack(r["counts"], len(k)) for r, k in zip(rows, keys, strict=True)])
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        return _answer(rows, keys, np.bincount(back, counts)[back] >= 2)

    return dealt.groupBy("block").applyInArrow(send, "shard int, block int, keys binary, counts binary").groupBy("shard").applyInArrow(answer, _FLAGS)


_SENT = "shard int, block int, keys binary, checks binary, docs binary, n int"


def _found(dealt: DataFrame, confirmed: DataFrame, n_shards: int) -> DataFrame:
    """The automata's work: each block's occurrences (shard -1), and its candidate windows with their smallest document, by shard."""

    def send(docs: pa.Table, flags: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if docs.num_rows:
            block = docs.column("block")[0].as_py()
            docs = blocks.opened(docs)
            parts = slices(docs.column("text"))
            places = occurrences(parts, anchor_counts(parts)[0][_flags(flags)])
            bits, n = pack_places(parts, places)
            rows.append((-1, block, bits, b"", b"", n))
            keys, checks, row, _ = candidate_windows(parts, places)
            if len(keys):
                order = np.lexsort((checks, keys))
                keys, checks = keys[order], checks[order]
                first = np.flatnonzero(opening(keys, checks))
                smallest = np.minimum.reduceat(_doc_ids(docs)[row[order]], first)
                keys, checks = keys[first], checks[first]
                rows.extend((shard, block, blocks.pack_keys(keys[at]), checks[at].tobytes(), blocks.pack_keys(smallest[at].view(np.uint64)), len(keys[at])) for shard, at in blocks.cuts(keys, n_shards))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int32()] * 2 + [pa.binary()] * 3 + [pa.int32()]
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["shard", "block", "keys", "checks", "docs", "n"])

    return dealt.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(send, _SENT)


def _firsts(found: DataFrame) -> DataFrame:
    """For each block, which of its candidate windows occur in no smaller document of another block."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [blocks.unpack_keys(r["keys"]) for r in rows]
        checks = np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in rows])
        docs = np.concatenate([blocks.unpack_keys(r["docs"]).view(np.int64) for r in rows])
        all_ = np.concatenate(keys)
        order = np.lexsort((checks, all_))
        new = opening(all_[order], checks[order])
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        smallest = np.minimum.reduceat(docs[order], np.flatnonzero(new))
        return _answer(rows, keys, docs == smallest[back])

    return found.filter("shard >= 0").groupBy("shard").applyInArrow(answer, _FLAGS)


def removed_words(parts: list[Slice], doc_ids: np.ndarray, places: list[np.ndarray], firsts: np.ndarray) -> list[np.ndarray]:
    """Which words of each slice are removed."""
    keys, checks, row, start = candidate_windows(parts, places)
    order = np.lexsort((start, doc_ids[row], checks, keys))
    new = opening(keys[order], checks[order])
    first, back = np.flatnonzero(new), np.cumsum(new) - 1
    doc = doc_ids[row][order]
    again = ~(firsts[back] & (doc == doc[first][back]) & (start[order] == start[order][first][back])) if len(first) else np.empty(0, bool)
    row, start = row[order][again], start[order][again]
    out = []
    for s in parts:
        own = (row >= s.w.first) & (row < s.w.first + s.w.n_docs)
        at = s.w.bounds[row[own] - s.w.first] + start[own]
        edge = np.zeros(len(s.w.hashes) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        out.append(np.cumsum(edge[:-1]) > 0)
    return out


def joined(w: T.Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each document, joined by one space."""
    length = (w.ends - w.starts + 1)[keep]
    low = np.cumsum(length) - length
    take = np.repeat(w.starts[keep] - low, length) + np.arange(int(length.sum()))
    data = np.append(w.data, np.uint8(32))[take]
    data[low + length - 1] = 32
    n = np.concatenate([[0], np.cumsum(keep)])
    edges = np.append(low, len(data))[n[w.bounds]]
    raw = data.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def deduplicated(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked, the kept text of every document."""
    spark = docs.sparkSession
    size = store.text_bytes(docs)
    dealt = blocks.blocked(docs.select("doc_id", "text"), store.parts(size))
    confirmed = store.written(_confirm(dealt, store.parts(size // 40, blocks.SHARD_KEYS)), "anchors")
    blocks.free(spark)
    found = store.written(_found(dealt, confirmed, store.parts(size // 12, blocks.SHARD_KEYS)), "found")
    store.delete(confirmed)
    blocks.free(spark)
    firsts = store.written(_firsts(found), "firsts")
    blocks.free(spark)
    hits = found.filter("shard < 0").select("block", "shard", F.col("keys").alias("flags"), "n")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])

    def cut(docs: pa.Table, flags: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs = blocks.opened(docs)
        parts = slices(docs.column("text"))
        is_hits = np.array(flags.column("shard").to_numpy() < 0, bool)
        places = unpack_places(parts, flags.filter(pa.array(is_hits)).column("flags")[0].as_py())
        gone = removed_words(parts, _doc_ids(docs), places, _flags(flags.filter(pa.array(~is_hits))))
        texts = [t for s, g in zip(parts, gone, strict=True) for t in joined(s.w, ~g)]
        counts = np.concatenate([s.w.counts for s in parts])
        lost = np.concatenate([T.per_doc(g, s.w.bounds) for s, g in zip(parts, gone, strict=True)])
        sha = [hashlib.sha256(t).hexdigest() for t in texts]
        kept = [t.decode() for t in texts] if with_text else [None] * len(texts)
        return pa.table([docs.column("doc_id"), pa.array(counts), pa.array(lost), pa.array(sha), pa.array(kept, pa.string())], schema=schema)

    return dealt.groupBy("block").cogroup(hits.unionByName(firsts).groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(store.documents(spark, sf_dir), with_text=False).drop("text")


SQL = r"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as j from texts),
windows as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from texts where len(w) >= 20)),
late as (select doc_id, i from windows qualify row_number() over (partition by k order by doc_id, i) > 1),
marked as (
  select w.doc_id, w.j, w.word, coalesce(max(l.i) over (partition by w.doc_id order by w.j rows unbounded preceding) >= w.j - 19, false) as gone
  from words w left join late l on l.doc_id = w.doc_id and l.i = w.j),
done as (
  select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by j) filter (not gone) as kept from marked group by 1)
select t.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from texts t left join done d on d.doc_id = t.doc_id
"""

QUERIES = {"op5_passage_dedup": query}
ORACLE_SQL = {"op5_passage_dedup": SQL}
