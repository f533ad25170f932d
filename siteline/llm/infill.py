"""Fill-in-middle transformation: documents cut at line ends by a parallel automaton scan.

One automaton reads a text byte by byte: whether a line is open, and how much of a sentinel (``<P>``,
``<S>`` or ``<M>``) has just been read.  A chunk of text doesn't know the state in which it is entered,
so it gives, for each state in which it may be, the state in which it ends, how many lines begin in it and how many
sentinels end in it.  Two neighbours' answers compose into that of both, and composition is associative; bytes
are composed in pairs within a chunk, and chunks within a document.  That tells each chunk's entry state and the
lines before it, hence the number of lines, the chunk that holds a cut and the cut's place among that chunk's lines.

Documents of at most ``CHUNK`` bytes are a chunk each and never move.  Longer ones are dealt out chunk by chunk; only the chunks'
answers (some hundred bytes each) meet again by document, and a document then needs to look into the two
chunks that hold its cuts.  A document itself is one row, in and out.

Prefix, middle and suffix are whole lines (``[^\\n]*\\n|[^\\n]+``).  A null text is empty.  Empty texts and those that hold a sentinel
stay as they are, as ``plain``.  A null doc_id is hashed like an empty one; rows that repeat give equal rows.  Other columns are not read;
those of the input named like a column of the result are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.llm import store
from siteline.llm import text as T

#: Bytes of a chunk; documents up to that are a chunk each.
CHUNK = 1 << 16
SEED = 7
#: Of 100 documents: how many are transformed, and how many of these are written suffix first.
RATE, SPM_RATE = 100, 50
#: Fixed values of the output format: what stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# The automaton.  Its state is 3 * (a line is open) + (0 nothing, 1 "<", 2 "<" and a letter).
_STATES = 6
_NEWLINE, _LESS, _LETTER, _GREATER = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
for _byte, _kind in ((10, _NEWLINE), (60, _LESS), (80, _LETTER), (83, _LETTER), (77, _LETTER), (62, _GREATER)):
    _CLASS[_byte] = _kind
_NEXT = np.zeros((5, _STATES), np.int8)
_BEGINS = np.zeros((5, _STATES), np.int64)  # 1 where a line begins
_MARKS = np.zeros((5, _STATES), np.int64)  # 1 where a sentinel ends
for _kind in range(5):
    for _state in range(_STATES):
        _open, _seen = divmod(_state, 3)
        _next = 1 if _kind == _LESS else 2 if _kind == _LETTER and _seen == 1 else 0
        _NEXT[_kind, _state] = _next if _kind == _NEWLINE else 3 + _next
        _BEGINS[_kind, _state] = 1 - _open
        _MARKS[_kind, _state] = _kind == _GREATER and _seen == 2


def compose(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The answers (end states, lines, sentinels; by entry state) of each of ``first`` followed by ``then``."""
    ends = first[0]
    at = ends.astype(np.intp)
    return np.take_along_axis(then[0], at, 1), first[1] + np.take_along_axis(then[1], at, 1), first[2] + np.take_along_axis(then[2], at, 1)


def reduced(answers: tuple[np.ndarray, ...], lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """The answers of consecutive spans of ``lengths`` symbols, each composed pair by pair; an empty span changes nothing."""
    lengths = lengths.copy()
    while lengths.max(initial=0) > 1:
        starts = np.cumsum(lengths) - lengths
        local = np.arange(len(answers[0])) - np.repeat(starts, lengths)
        paired = local + 1 < np.repeat(lengths, lengths)
        left = np.flatnonzero((local % 2 == 0) & paired)
        both = compose(tuple(a[left] for a in answers), tuple(a[left + 1] for a in answers))
        kept = np.flatnonzero(local % 2 == 0)
        answers = tuple(a[kept] for a in answers)
        for a, b in zip(answers, both, strict=True):
            a[np.searchsorted(kept, left)] = b
        lengths = (lengths + 1) // 2
    out = (np.tile(np.arange(_STATES, dtype=np.int8), (len(lengths), 1)), np.zeros((len(lengths), _STATES), np.int64), np.zeros((len(lengths), _STATES), np.int64))
    for a, b in zip(out, answers, strict=True):
        a[lengths > 0] = b
    return out


def scan(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The answers of the chunks ``data[bounds[i]:bounds[i + 1]]``.

    A run of bytes of no class acts as one of them: it leaves every state at its first byte for one in which
    nothing more begins or ends.
    """
    kinds = _CLASS[data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = (kinds[1:] != 0) | (kinds[:-1] != 0)
    keep[bounds[:-1][bounds[:-1] < len(kinds)]] = True
    at = np.flatnonzero(keep)
    symbols = kinds[at]
    return reduced((_NEXT[symbols], _BEGINS[symbols], _MARKS[symbols]), np.diff(np.searchsorted(at, bounds)))


def begins(data: np.ndarray, entry: int = 0) -> np.ndarray:
    """Where lines begin in a chunk that is entered in state ``entry``."""
    after = np.flatnonzero(data == 10) + 1
    first = [0] if entry < 3 and len(data) else []
    return np.concatenate([np.array(first, np.int64), after[after < len(data)]])


def code_points(data: np.ndarray) -> int:
    return int(((data & 0xC0) != 0x80).sum())


def _hashes(seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _form(n: int, marks: int, h3: int, h4: int, rate: int, spm_rate: int) -> str:
    return "plain" if not n or marks or h3 % 100 >= rate else "spm" if h4 % 100 < spm_rate else "psm"


def _written(text: bytes, form: str, low: int, high: int) -> bytes:
    if form == "plain":
        return text
    p, m, s = PREFIX.encode() + text[:low], MIDDLE.encode() + text[low:high], SUFFIX.encode() + text[high:]
    return s + p + m if form == "spm" else p + s + m


def _columns(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and its bounds."""
    column = T.large(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _short(rate: int, spm_rate: int, rows: int = 256):
    """Transforms documents that are a chunk each."""

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = _columns(batch.column("text"))
        _, lines, marks = scan(data, bounds)
        n = lines[:, 0]
        prior = np.empty(len(data), bool)  # where a line begins
        prior[1:] = data[:-1] == 10
        prior[bounds[:-1][bounds[:-1] < len(data)]] = True
        begin = np.append(np.flatnonzero(prior), len(data))
        h = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
        one, two = h[0] % (n + 1), h[1] % (n + 1)
        base = np.searchsorted(begin, bounds[:-1])
        cut = [np.where(k >= n, bounds[1:], begin[np.minimum(base + k, len(begin) - 1)]) for k in (np.minimum(one, two), np.maximum(one, two))]
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        forms = [_form(*x, rate, spm_rate) for x in zip(n.tolist(), marks[:, 0].tolist(), h[2].tolist(), h[3].tolist(), strict=True)]
        plain = np.array([f == "plain" for f in forms], bool)
        out = [_written(data[a:b].tobytes(), f, low - a, high - a) for a, b, f, low, high in zip(bounds[:-1], bounds[1:], forms, cut[0], cut[1], strict=True)]
        chars = [pa.array(heads[b] - heads[a], pa.int64(), mask=plain) for a, b in ((bounds[:-1], cut[0]), (cut[0], cut[1]))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(forms, pa.string()), *chars, pa.array(out, pa.binary()).cast(pa.string())], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                yield part(batch.slice(low, rows))

    return store.trimmed(run)


def _cut_up(size: int):
    """key, chunk, data: the chunks of long documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                raw = text.as_buffer()
                for k in range(-(-raw.size // size)):
                    piece = raw.slice(k * size, min(size, raw.size - k * size)).to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([k], pa.int32()), pa.array([piece], pa.binary())], ["key", "chunk", "data"])

    return run


_ANSWER = "key string, chunk int, chars long, ends binary, lines binary, marks binary"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            data = np.frombuffer(batch.column("data")[row].as_buffer(), np.uint8)
            found = scan(data, np.array([0, len(data)]))
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(row, 1), batch.column("chunk").slice(row, 1), pa.array([code_points(data)], pa.int64()), *(pa.array([x[0].tobytes()], pa.binary()) for x in found)], ["key", "chunk", "chars", "ends", "lines", "marks"])


_PLAN = "key string, n long, marks long, low_chunk int, low_entry int, low_line long, low_chars long, high_chunk int, high_entry int, high_line long, high_chars long"


def _resolve(key: tuple, chunks: pd.DataFrame) -> pd.DataFrame:
    """Entry states and lines before each chunk of one document, and which chunk holds each cut (chunk -1: the text's end)."""
    chunks = chunks.sort_values("chunk")
    state, n, marks, chars, entries = 0, 0, 0, 0, []
    for row in chunks.itertuples():
        entries.append((int(row.chunk), state, n, chars))
        n += int(np.frombuffer(row.lines, np.int64)[state])
        marks += int(np.frombuffer(row.marks, np.int64)[state])
        state, chars = int(np.frombuffer(row.ends, np.int8)[state]), chars + int(row.chars)
    before = np.array([e[2] for e in entries])
    out = [key[0], n, marks]
    one, two = int(chunks.h1.iloc[0]) % (n + 1), int(chunks.h2.iloc[0]) % (n + 1)
    for k in (min(one, two), max(one, two)):
        if k >= n:
            out += [-1, 0, 0, chars]
        else:  # the last chunk with no more lines before it is where line k begins
            chunk, entry, lines, passed = entries[int(np.searchsorted(before, k, "right")) - 1]
            out += [chunk, entry, k - lines, passed]
    return pd.DataFrame([out], columns=[x.split()[0] for x in _PLAN.split(", ")])


def _long(rate: int, spm_rate: int, size: int):
    """Writes long documents whose cuts' chunks are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.drop_columns("text").to_pylist()):
                raw = np.frombuffer(batch.column("text")[k].as_buffer(), np.uint8)
                cuts, chars = [], []
                for side in ("low", "high"):
                    chunk = row[f"{side}_chunk"]
                    if chunk < 0:
                        cuts.append(len(raw))
                        chars.append(row[f"{side}_chars"])
                        continue
                    data = raw[chunk * size : (chunk + 1) * size]
                    place = int(begins(data, row[f"{side}_entry"])[row[f"{side}_line"]])
                    cuts.append(chunk * size + place)
                    chars.append(row[f"{side}_chars"] + code_points(data[:place]))
                form = _form(row["n"], row["marks"], row["h3"], row["h4"], rate, spm_rate)
                shown = form != "plain"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_id"]], pa.int64()), pa.array([row["n"]], pa.int64()), pa.array([form]), *(pa.array([x if shown else None], pa.int64()) for x in (chars[0], chars[1] - chars[0])), pa.array([_written(raw.tobytes(), form, *cuts)], pa.binary()).cast(pa.string())],
                    schema=_OUT,
                )

    return store.trimmed(run)


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document."""
    store.small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = own.filter(F.octet_length("text") <= chunk).select("*", *_hashes(seed)).mapInArrow(_short(rate, spm_rate), OUT)
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(F.col("text").cast("binary"), 256))
    long = own.filter(F.octet_length("text") > chunk).withColumn("key", key)
    chunks = long.select("key", "text").mapInArrow(_cut_up(chunk), "key string, chunk int, data binary").repartition("key", "chunk")
    drawn = chunks.mapInArrow(_answer, _ANSWER).dropDuplicates(["key", "chunk"])  # rows that repeat have equal chunks
    first, second, *_ = _hashes(seed)
    named = drawn.withColumn("doc_id", F.substring_index("key", ":", 1)).select("*", first, second).drop("doc_id")
    plan = named.groupBy("key").applyInPandas(_resolve, _PLAN)
    met = long.join(plan, "key").select("*", *_hashes(seed)[2:]).drop("key")
    return short.unionByName(met.mapInArrow(_long(rate, spm_rate, chunk), OUT))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, cuts in code points, and digests of its output and of the text rebuilt from that."""
    out = transformed(store.documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}

ORACLE_SQL = {
    "op11_fill_in_middle": """
with t as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
 u as (select doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') as units, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2, cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from t),
 c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
   case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
 p as (select doc_id, text, n, form, array_to_string(units[1:a], '') as pre, array_to_string(units[a + 1:b], '') as mid, array_to_string(units[b + 1:n], '') as suf from c),
 o as (select *, case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end as output from p)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars, sha256(output) as output_sha256, sha256(text) as restored_sha256 from o"""
}
