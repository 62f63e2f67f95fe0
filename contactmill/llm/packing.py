"""Packing of stored texts into token sequences of one length.

Every text is cut at whole windows; what is left of it, its tail, is shorter than a
window. The histogram of tail lengths is matched with combinations of a few lengths that
fill a window exactly: non-negative least squares gives how often each is
used, rounding makes that whole, and the tails it leaves over are laid end to end
and cut where a window is full. The plan depends on the histogram alone, so its size has a
bound whatever the number of texts; each text finds its place from its rank among
tails of its length.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from contactmill.llm.rows import stream_rows
from contactmill.operators.numbering import number_rows
from contactmill.session import cut_lineage

DEPTH = 6
SHIFTS = (0, 61, -61)
SWEEPS = 12
CACHED_CHUNKS, LEFT_CHUNKS, CHUNKS_AT_ONCE = 200_000, 1 << 16, 1 << 14
BATCH_OCTETS = 2 << 20
MARK = "|"
# What may compose with the letter before it: no letter, number, sign or blank of any kind, nor ASCII.
COMPOSING = r"[^\x00-\x7f\p{L}\p{N}\p{P}\p{S}\p{Z}]"
PIECES = (
    "id long, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long"
)


class Recent(dict):
    """Ids of chunks. An unknown chunk gives nothing and is noted; one known to ``old`` is taken over."""

    def __init__(self, old: dict):
        super().__init__({"": b""})
        self.old, self.unknown = dict(old), set()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            self.unknown.add(chunk)
            return b""
        self[chunk] = ids
        return ids


class ChunkEncoder:
    """Ids of whole texts, put together from the ids of their parts between blanks.

    Good for vocabularies whose tokens never cross a blank or line break and whose text
    preparation works on single characters; the parts themselves go through the library.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.mark = self.library.encode(MARK, add_special_tokens=False).ids[0]
        self.ids = Recent({})

    def _learn(self) -> None:
        """Encode the unknown chunks, many in one text, each followed by a mark that is one token."""
        unknown = [c for c in self.ids.unknown if MARK not in c and "<|" not in c]
        for chunk in self.ids.unknown.difference(unknown):
            self.ids[chunk] = np.array(self.library.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()
        self.ids.unknown = set()
        for at in range(0, len(unknown), CHUNKS_AT_ONCE):
            part = unknown[at : at + CHUNKS_AT_ONCE]
            text = "".join([f"{c} {MARK} " for c in part])
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(ids == self.mark)
            ids, size = ids.tobytes(), ids.itemsize
            ends = (ends * size).tolist()
            starts = [0, *(e + size for e in ends)]
            self.ids.update(zip(part, (ids[x:y] for x, y in zip(starts, ends))))

    def forget(self) -> None:
        """Keep only the chunks that came first, which are the frequent ones."""
        self.ids = Recent(dict(itertools.islice(self.ids.items(), LEFT_CHUNKS)))

    @staticmethod
    def _plain(texts: pa.StringArray) -> pa.StringArray:
        """The same tokens from fewer different chunks: ASCII in lower case, and closing marks apart from their word.

        A capital before a combining mark stays, since the vocabulary composes the two before it
        lowers case, and some pairs compose in lower case only. A text that may spell a special
        token is left alone, since those have no other case.
        """
        texts = texts.fill_null("")
        lower, marked = pc.ascii_lower(texts), pc.match_substring_regex(texts, f"[A-Z]{COMPOSING}")
        if marked.true_count:
            kept = [regex.sub(f"[A-Z]+(?!{COMPOSING})", lambda m: m[0].lower(), t) for t in texts.filter(marked).to_pylist()]
            lower = pc.replace_with_mask(lower, marked, pa.array(kept, pa.string()))
        lower = pc.replace_substring_regex(lower, r"([0-9a-z])([.,]+)([ \n]|$)", r"\1 \2\3")
        return pc.if_else(pc.match_substring(texts, "<|"), texts, lower)

    def encode_batch(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of each text. The distinct chunks of the batch are looked up once; numpy lays their ids out."""
        if len(self.ids) > CACHED_CHUNKS:
            self.ids = Recent(self.ids)
        chunks = pc.split_pattern(pc.replace_substring(self._plain(texts), "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.ids.__getitem__, distinct))
        if self.ids.unknown:
            self._learn()
            found = list(map(self.ids.__getitem__, distinct))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.dtype).itemsize
        tokens, first = np.frombuffer(b"".join(found), self.dtype), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        flat = tokens[np.repeat(first[at] - ends[:-1], sizes[at]) + np.arange(ends[-1])]
        bounds = ends[chunks.offsets.to_numpy()]
        return [flat[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch(pa.array([text], pa.string()))[0]


def parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about ``BATCH_OCTETS`` together."""
    sizes = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + BATCH_OCTETS)))
        yield batch.slice(at, end - at)
        at = end


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core
    return ChunkEncoder(path)


def combinations(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """Combinations of at most ``DEPTH`` of the lengths that add up to the window: each length with parts of about equal size."""
    present, found = set(lengths), set()
    for largest in lengths:
        for parts in range(1, DEPTH):
            for shift in SHIFTS if parts > 1 else (0,):
                rest, chosen = window - largest, [largest]
                for left in range(parts, 1, -1):
                    at = bisect.bisect_left(lengths, max(1, rest // left + shift))
                    if at == len(lengths) or lengths[at] >= rest:
                        break
                    chosen.append(lengths[at])
                    rest -= lengths[at]
                if len(chosen) == parts and rest in present:
                    found.add(tuple(sorted([*chosen, rest])))
    return sorted(found)


def non_negative_least_squares(patterns: list[tuple[int, ...]], counts: dict[int, int]) -> list[float]:
    """How often to use each pattern so that the uses of all lengths come close to their counts; coordinate descent."""
    columns = [[(n, p.count(n)) for n in set(p)] for p in patterns]
    norms = [sum(m * m for _, m in c) for c in columns]
    left = {n: float(c) for n, c in counts.items()}
    uses = [0.0] * len(patterns)
    for _ in range(SWEEPS):
        for j, column in enumerate(columns):
            step = sum(m * left[n] for n, m in column) / norms[j]
            step = max(step, -uses[j])
            if step:
                uses[j] += step
                for n, m in column:
                    left[n] -= m * step
    return uses


@dataclass
class Plan:
    """Where tails go, by their rank when ordered by length: parallel arrays of runs of ranks.

    A run of kind 0 fills one slot of a pattern: rank ``first + k`` goes to sequence
    ``base + k`` at ``offset``. A run of kind 1 is laid end to end from token ``base`` of the stream of
    left-over tails, which fills the sequences from ``stream`` on.
    """

    first: np.ndarray
    length: np.ndarray
    kind: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    stream: int
    n_sequences: int
    window: int

    def pieces(self, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the tail, length, sequence, offset) of the tail with this rank."""
        run = int(np.searchsorted(self.first, rank, "right")) - 1
        k, n = rank - int(self.first[run]), int(self.length[run])
        if self.kind[run] == 0:
            return [(0, n, int(self.base[run]) + k, int(self.offset[run]))]
        at = int(self.base[run]) + k * n
        cut = min(n, self.window - at % self.window)
        out = [(0, cut, self.stream + at // self.window, at % self.window)]
        if cut < n:
            out.append((cut, n - cut, out[0][2] + 1, 0))
        return out


def plan_tails(counts: dict[int, int], window: int) -> Plan:
    """Plan for ``counts`` tails of each length below the window."""
    patterns = combinations(sorted(counts), window)
    uses = non_negative_least_squares(patterns, counts)
    left = dict(counts)
    runs, sequence = [], 0
    slots: dict[int, list] = {n: [] for n in counts}
    for j in sorted(range(len(patterns)), key=lambda j: (-uses[j], patterns[j])):
        pattern = patterns[j]
        times = min([round(uses[j])] + [left[n] // pattern.count(n) for n in set(pattern)])
        if times <= 0:
            continue
        offset = 0
        for n in pattern:
            slots[n].append((times, sequence, offset))
            left[n] -= times
            offset += n
        sequence += times
    first = token = 0
    for n in sorted(counts):
        for times, base, offset in slots[n]:
            runs.append((first, n, 0, base, offset))
            first += times
        if left[n]:
            runs.append((first, n, 1, token, 0))
            first += left[n]
            token += left[n] * n
    columns = [np.array(c, np.int64) for c in zip(*runs)] if runs else [np.zeros(0, np.int64)] * 5
    return Plan(*columns, stream=sequence, n_sequences=sequence + -(-token // window), window=window)


def pack_sources(raw_sources: DataFrame, vocabulary: str, end_id: int = 2, window: int = 4096) -> DataFrame:
    """Pieces of all raw sources, packed into sequences of at most ``window`` tokens.

    A source's tokens are those of its whole ``raw_text`` (null counts as
    empty) and ``end_id`` after them. Gives one row per piece: ``id``, ``start`` (tokens of
    the source before it), ``length``, ``token_ids`` (little-endian unsigned
    32-bit), ``doc_tokens``, ``sequence_id`` and ``offset``. Each token is in one piece; the
    pieces of a sequence follow each other from offset 0, and every sequence but
    the last of the left-over tails is full. Repeated rows and null ids are packed like others; other columns are
    ignored; an empty table gives no pieces.

    Tokens are written once to the shared folder; ranks are taken on a range-sorted
    table of two numbers per source; the plan (at most ``window`` lengths) is made on the driver.
    """
    schema = "id long, doc_tokens long, id_bytes int, ids binary"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary)
        end, size = np.array([end_id], model.dtype).tobytes(), np.dtype(model.dtype).itemsize
        try:
            for batch in batches:
                for part in parts(batch, 1):
                    texts = part.column(1).cast(pa.string())
                    ids = [x + end for x in model.encode_batch(texts)]
                    columns = part.column(0).to_pylist(), [len(x) // size for x in ids], [size] * len(ids), ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, target)], schema=target)
        finally:
            model.forget()  # a Python worker outlives its task and runs other stages
            pa.default_memory_pool().release_unused()

    tokens = raw_sources.select("id", "raw_text").mapInArrow(tokenized, schema)
    tokens = cut_lineage(tokens.withColumn("source", F.monotonically_increasing_id()))

    tails = tokens.select("source", "doc_tokens", (F.col("doc_tokens") % window).alias("tail")).where("tail > 0")
    counts = {r["tail"]: r["n"] for r in tails.groupBy("tail").agg(F.count("*").alias("n")).collect()}
    shared = raw_sources.sparkSession.sparkContext.broadcast(plan_tails(counts, window))
    ranked = number_rows(tails, ["tail", "source"], "rank")

    def place(frames):
        plan = shared.value
        for source, n, tail, rank in frames:
            for start, length, sequence, offset in plan.pieces(rank - 1):
                yield source, n - tail + start, length, sequence, offset

    placed = "source long, start long, length long, sequence_id long, offset long"
    ends = stream_rows(ranked.select("source", "doc_tokens", "tail", "rank"), place, placed)
    whole = tokens.where(F.col("doc_tokens") >= window).select(
        "source", F.explode(F.sequence(F.lit(0), F.expr(f"doc_tokens div {window}") - 1)).alias("at")
    )
    whole = number_rows(whole, ["source", "at"], "no", start=shared.value.n_sequences - 1).select(
        "source", (F.col("at") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
        F.col("no").cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    cuts = ends.unionByName(whole).groupBy("source").agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces")
    )

    def cut(rows):
        for i, n, size, ids, pieces in rows:
            for p in pieces:
                part = ids[p["start"] * size : (p["start"] + p["length"]) * size]
                part = np.frombuffer(part, f"<u{size}").astype("<u4").tobytes()
                yield i, p["start"], p["length"], part, n, p["sequence_id"], p["offset"]

    joined = tokens.join(cuts, "source").select("id", "doc_tokens", "id_bytes", "ids", "pieces")
    return stream_rows(joined, cut, PIECES)
