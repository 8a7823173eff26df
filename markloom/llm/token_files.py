"""Token-id output in Simple-8b words, written and read back by Spark.

File format. A table of blocks; a block is a run of documents in ascending doc_id order:

    part, block        file part (ascending with doc_id) and running number in it
    before             ids in the part before this block
    doc_ids, counts    the documents and their numbers of ids
    n                  ids in the block
    offsets            uint32 LE: first word of every lane of LANE ids, then the word count
    words              uint64 LE: Simple-8b words

A word's top 4 bits select how many ids share its other 60 bits: selector k stands for
PER_WORD[k] ids of 60 // PER_WORD[k] bits each, lowest bits first. Selector 15 is the
escape: the next word holds one id of up to 64 bits as it is. Words never cross lanes, so
all lanes are packed side by side and any word is decoded without those before it.

Encoding uses the tokenizers library. A chunk of text from one single blank to the next
is always a whole number of pre-tokens, so each distinct chunk is encoded once a group of
texts; texts with other white space or runs of blanks, or with the string of an added
token, are handed over whole. Such strings become the token, which is the library's default.

Defined results for odd input
    null text        empty: only the end id
    null doc_id      sorts before all ids
    repeated rows    each is written, next to each other
    very long texts  whole; memory follows the longest document
    empty table      no file blocks, empty result
    extra columns    ignored
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm._io import new_path
from markloom.llm._ragged import flatten, per_document, spread

END_ID = 2
LANE = 512
PER_WORD = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK_IDS = 1 << 18
#: Bytes of text whose distinct chunks are encoded together, and chunks in one call's string.
GROUP_BYTES = 8 << 20
JOINED = 200
#: White space that a cut before every blank would tear apart.
ODD_SPACE = r"  |\n \n|\n \z|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

BLOCKS = "part int, block int, before long, doc_ids array<long>, counts array<int>, n long, offsets binary, words binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids -> (offsets uint32, words uint64)."""
    flat = ids.astype(np.uint64)
    total = len(flat)
    lanes = -(-total // LANE)
    if not total or flat.max() < 1 << 24:
        bits = ((flat.astype(np.float32).view(np.uint32) >> 23) - 126).astype(np.uint8)
        bits[flat == 0] = 0
    else:
        low = np.frexp((flat & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
        high = np.frexp((flat >> np.uint64(32)).astype(np.float64))[1]
        bits = np.where(high > 0, high + 32, low).astype(np.uint8)
    # How many ids from each place on fit one word. If n fit, so does any smaller number.
    widest = {1: bits}
    count = np.ones(total, np.uint8)
    done = 1
    for n in reversed(PER_WORD[:-1]):
        if n > total:
            break
        wide = np.maximum(widest[done][: total - n + 1], widest[n - done][done : total - n + 1 + done])
        fits = wide <= 60 // n
        if not fits.any():
            break
        np.putmask(count[: total - n + 1], fits, np.uint8(n))
        widest[n], done = wide, n
    count[bits > 60] = 0
    at = np.arange(lanes) * LANE
    ends = np.minimum(at + LANE, total)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    lane = np.arange(lanes)
    used = np.zeros(lanes, np.int64)
    while len(lane):
        c = _FLOOR[np.minimum(count[at], ends[lane] - at)]
        steps.append((lane, at, used[lane], c))
        used[lane] += 1 + (c == 0)
        at = at + np.maximum(c, 1)
        more = at < ends[lane]
        if not more.all():
            lane, at = lane[more], at[more]
    offsets = np.concatenate([[0], np.cumsum(used)])
    words = np.zeros(int(offsets[-1]), np.uint64)
    if steps:
        start = np.concatenate([s[1] for s in steps])
        place = np.concatenate([offsets[s[0]] + s[2] for s in steps])
        c = np.concatenate([s[3] for s in steps])
        for k, n in enumerate(PER_WORD):
            mine = np.flatnonzero(c == n)
            if len(mine):
                first, b = start[mine], 60 // n
                word = np.full(len(first), k << 60, np.uint64)
                for j in range(n):
                    word |= flat[first + j] << np.uint64(j * b)
                words[place[mine]] = word
        mine = c == 0
        words[place[mine]] = np.uint64(ESCAPE << 60)
        words[place[mine] + 1] = flat[start[mine]]
    return offsets.astype("<u4"), words.astype("<u8")


#: The largest number of ids in a word that is not above an index; 0 stays the escape.
_FLOOR = np.array([max((n for n in PER_WORD if n <= k), default=0) for k in range(PER_WORD[0] + 1)], np.int64)


def unpack(n: int, words: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
    """n ids from their words; with offsets, each lane's ids are placed from the lane's own first word.

    ``words[offsets[k]:offsets[k + 1]]`` alone are the words of lane k, so any run of lanes may be given.
    """
    out = np.zeros(n, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    #: A literal is known from the escape before it; a literal may itself look like an escape.
    literal = np.zeros(len(words), bool)
    for k in np.flatnonzero(selector == ESCAPE).tolist():
        if not literal[k]:
            literal[k + 1] = True
    per = np.array([*PER_WORD, 0, 0], np.int64)[selector]
    per[literal] = 1
    place = np.cumsum(per) - per
    if offsets is not None and len(offsets) > 1:
        lane = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
        place += (np.arange(len(offsets) - 1) * LANE - place[offsets[:-1].astype(np.int64) - int(offsets[0])])[lane]
    for k, count in enumerate(PER_WORD):
        mine = np.flatnonzero((selector == k) & ~literal)
        if len(mine):
            at, body, b = place[mine], words[mine], 60 // count
            keep = np.uint64((1 << b) - 1)
            for j in range(count):
                out[at + j] = (body >> np.uint64(j * b)) & keep
    out[place[literal]] = words[literal]
    return out


class Encoder:
    """Ids of whole texts by a tokenizers model of the byte-level kind; one for each Python worker."""

    made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; a pool of threads only costs memory
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        #: Texts that may hold an added token's string are encoded whole, as the library does by default.
        added = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.whole_only = "|".join([ODD_SPACE, *added])
        vocabulary = self.model.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.token_bytes[k] = len(token)  # a byte is one character there
        self.stop, self.comma = vocabulary["."], vocabulary[","]
        #: Distinct words of the last group of texts, with their numbers of ids and ids.
        self.last = (pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32))

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of texts one by one."""
        lengths, ids = flatten([e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        return lengths, ids.astype(np.int32)

    def chunks(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of each distinct word with a blank before it.

        A full stop or comma that ends a word after a letter is a pre-token of its own, so
        words are encoded without it.
        """
        tail = pc.match_substring_regex(words, "[A-Za-z][.,]$")
        coded = pc.if_else(tail, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        per, values = spread(coded.indices.to_numpy(zero_copy_only=False), *self.remembered(coded.dictionary))
        tail = tail.to_numpy(zero_copy_only=False).astype(bool)
        lengths = per + tail
        at = np.cumsum(lengths)[tail] - 1
        ids = np.empty(int(lengths.sum()), np.int32)
        own = np.ones(len(ids), bool)
        own[at] = False
        ids[own] = values
        stops = pc.ends_with(words, ".").to_numpy(zero_copy_only=False).astype(bool)[tail]
        ids[at] = np.where(stops, self.stop, self.comma)
        return lengths, ids

    def remembered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of distinct words; those of the group before are not encoded again."""
        known, lengths, values = self.last
        at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        new_lengths, new_values = self.joined(words.filter(pa.array(new)).to_pylist())
        at[new] = len(known) + np.arange(int(new.sum()))
        found = spread(at, np.concatenate([lengths, new_lengths]), np.concatenate([values, new_values]))
        self.last = (words, *found)
        return found

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of each word with a blank before it.

        Words are encoded many at a time: a cut before a blank is always between
        pre-tokens, if the words neither are empty nor begin or end in a line feed. Ids
        are dealt back to words by their bytes.
        """
        alone = np.array([not w or w[0] == "\n" or w[-1] == "\n" for w in words], bool)
        joint = [w for w, x in zip(words, alone.tolist(), strict=True) if not x]
        text = [" " + " ".join(joint[k : k + JOINED]) for k in range(0, len(joint), JOINED)]
        _, ids = self.whole(text)
        ends = np.cumsum(pc.binary_length(pa.array(joint, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        until = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends, side="right")
        lengths = np.zeros(len(words), np.int64)
        lengths[~alone] = np.diff(until, prepend=0)
        if alone.any():
            single, extra = self.whole([" " + w for w, x in zip(words, alone.tolist(), strict=True) if x])
            at = (np.cumsum(lengths) - lengths)[alone]
            ids = np.insert(ids, np.repeat(at, single), extra)
            lengths[alone] = single
        return lengths, ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each); no end ids."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.whole_only).to_numpy(zero_copy_only=False).astype(bool)
        parts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        words = parts.flatten()
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = words.dictionary_encode()
        index, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        head = np.zeros(len(index), bool)
        head[bounds[:-1][np.diff(bounds) > 0]] = True  # a text's first chunk has no blank before it
        bare, place = np.unique(index[head], return_inverse=True)
        lengths, values = self.chunks(names)
        bare_lengths, bare_values = self.whole(names.take(pa.array(bare)).to_pylist())
        index = index.copy()
        index[head] = len(names) + place
        per, ids = spread(index, np.concatenate([lengths, bare_lengths]), np.concatenate([values, bare_values]))
        counts = per_document(per, bounds)
        if odd.any():
            at = np.cumsum(counts) - counts
            extra, values = self.whole(texts.filter(pa.array(odd)).to_pylist())
            ids = np.insert(ids, np.repeat(at[odd], extra), values)
            counts[odd] = extra
        return ids, counts


def _write(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, before = TaskContext.get().partitionId(), 0, 0
        encoder = Encoder.of(path)
        for batch in batches:
            lengths = np.cumsum(pc.binary_length(batch.column(1).fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(lengths, (lengths[a - 1] if a else 0) + GROUP_BYTES, side="right")))
                ids, counts = encoder.encode(batch.column(1).slice(a, b - a))
                ends = np.cumsum(counts)
                x = 0
                while x < b - a:
                    y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + block_ids, side="right")))
                    mine = ids[(ends[x - 1] if x else 0) : ends[y - 1]]
                    each = counts[x:y] + 1
                    mine = np.insert(mine, np.cumsum(counts[x:y]), end_id)
                    offsets, words = pack(mine)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "before": pa.array([before], pa.int64()),
                            "doc_ids": pa.array([batch.column(0).slice(a + x, y - x).to_pylist()], pa.list_(pa.int64())),
                            "counts": pa.array([each.tolist()], pa.list_(pa.int32())), "n": pa.array([len(mine)], pa.int64()),
                            "offsets": pa.array([offsets.tobytes()]), "words": pa.array([words.tobytes()]),
                        }
                    )
                    block, before, x = block + 1, before + len(mine), y
                a = b

    return run


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode all rows and write the file format described above to ``path``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_write(tokenizer, end_id, BLOCK_IDS), BLOCKS).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = unpack(r["n"], np.frombuffer(r["words"], "<u8"), np.frombuffer(r["offsets"], "<u4")).astype("<u4")
            counts = np.array(r["counts"], np.int64)
            ends = np.cumsum(counts)
            raw = memoryview(ids.tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(r["doc_ids"], pa.int64()),
                    "start": pa.array(r["start"] + ends - counts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.int64()),
                }
            )


def read(docs_path: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the blocks of a token file table."""
    blocks = docs_path
    spark = blocks.sparkSession
    # One row for each file part, and as many as the writing had tasks.
    totals = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n")).collect())
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    shift = F.broadcast(spark.createDataFrame(starts, "part int, shift long"))
    placed = blocks.join(shift, "part").withColumn("start", F.col("shift") + F.col("before"))
    return placed.select("start", "n", "doc_ids", "counts", "offsets", "words").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def roundtrip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write token files into the shared folder and describe what is read back from them."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write(docs, path, tokenizer, doc_id, text)
    return read(spark.read.schema(BLOCKS).parquet(path))
