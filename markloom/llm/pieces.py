"""SentencePiece encoding and decoding by a relational lattice and a Viterbi fold.

The model is a read-only SentencePiece file; nothing is trained. A text is cut before
every blank and every line feed into words (a blank becomes the mark U+2581); no piece
spans such a cut. For one word

  * every substring of at most the longest piece's length is exploded to a row,
  * rows are equi-joined to the piece table (bounded by the vocabulary, so broadcast),
  * the edges are grouped by word, and
  * ``aggregate`` folds them into the best path, a state for each position.

A piece's score is -ln(1 + its rank in the model): piece files of the BPE kind hold ranks
only, whose plain sums would favour many small pieces. Ids are the model's own, so any
SentencePiece decoder reads them; they need not be the ones that BPE merging would pick.
Ties go to the edge that starts later. A character without a piece is spelt in the
model's byte pieces, at BYTE_SCORE a byte, so that every text comes back exactly.

The relational form runs over the words that make up at least 1/FREQUENT of the corpus;
there are at most FREQUENT of those, whatever its size, so their ids may be shipped to
every task. All other words are encoded where they stand, by the same lattice and the
same fold over arrays (``encode_words``), once for each batch: sending rare words through
a shuffled join would move more bytes than the texts hold.

Defined results for odd input
    null text        no pieces, decodes to the empty text
    null doc_id      encoded like any other row
    long words       no limit; memory follows the longest document
    repeated rows    each is returned
    empty table      empty result
    extra columns    ignored
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markloom.llm._io import materialise, trimmed
from markloom.llm._ragged import distinct, flatten, per_document, spread
from markloom.llm._text import _INVERSE, _BASE, _power, mix

MARK = "▁"
BYTE_SCORE = -14.0
FREQUENT = 200_000
#: Bytes of text encoded at once.
CHUNK_BYTES = 3 << 20
#: Characters of words folded side by side.
FOLD_CHARS = 1 << 18
U = np.uint64


@dataclass
class Model:
    """Piece strings, ids and scores, and the id of each byte."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    surfaces: list[bytes]
    longest: int

    loaded = {}

    @classmethod
    def of(cls, path: str) -> Model:
        """Read a model file, once for each Python process."""
        if path in cls.loaded:
            return cls.loaded[path]
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, surfaces, byte_ids = {}, [], [0] * 256
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            surfaces.append(name.replace(MARK, " ").encode())
            if sp.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
                surfaces[i] = bytes([int(name[3:5], 16)])
            elif sp.is_control(i) or sp.is_unknown(i):
                surfaces[i] = b""
            elif name == MARK:  # no rank in the file: the last
                pieces[name] = (i, -float(np.log(1.0 + sp.get_piece_size())))
            elif sp.get_score(i) > -1e6 and MARK not in name[1:]:
                pieces[name] = (i, -float(np.log(1.0 - sp.get_score(i))))
        cls.loaded[path] = cls(pieces, byte_ids, surfaces, max(map(len, pieces)))
        return cls.loaded[path]


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, bounds). A word that starts with a line feed has no mark before it."""
    parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    return parts.flatten(), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _marked(word: str) -> str:
    return word if word[:1] == "\n" else MARK + word


def word_ids_relational(words: DataFrame, path: str) -> DataFrame:
    """words(word) distinct, marked -> (word, ids): lattice, join and fold in Spark."""
    spark = words.sparkSession
    model = Model.of(path)
    table = spark.createDataFrame([(p, i, s) for p, (i, s) in model.pieces.items()], "piece string, id int, score double")
    size = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    spans = starts.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), size - F.col("s")))).alias("n"))
    edges = spans.select("word", "s", "n", F.substring("word", F.col("s") + 1, F.col("n")).alias("piece"))
    # A mark inside a word is a character of the text, not a blank.
    joinable = F.when((F.col("s") == 0) | ~F.startswith("piece", F.lit(MARK)), F.col("piece"))
    met = edges.withColumn("key", joinable).join(F.broadcast(table.withColumnRenamed("piece", "key")), "key", "left")
    hexes = F.hex(F.encode("piece", "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.length(hexes), F.lit(2)), lambda k: F.conv(F.substring(hexes, k, F.lit(2)), 16, 10).cast("int"))
    spelt = F.transform(codes, lambda c: F.get(F.lit(model.byte_ids), c))
    lattice = met.filter("id is not null or n = 1").select(
        "word",
        F.struct(
            (F.col("s") + F.col("n")).alias("e"),
            "s",
            F.when(F.col("id").isNull(), spelt).otherwise(F.array("id")).alias("ids"),
            F.coalesce("score", F.lit(BYTE_SCORE) * F.octet_length("piece")).alias("score"),
        ).alias("edge"),
    )
    grouped = lattice.groupBy("word").agg(F.collect_list("edge").alias("edges"))
    begin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"), F.array().cast("array<int>").alias("ids")))

    def step(state, e):
        into = F.filter("edges", lambda x: x["e"] == e)
        ways = F.transform(into, lambda x: F.struct((F.get(state, x["s"])["score"] + x["score"]).alias("score"), x["s"].alias("s"), x["ids"].alias("ids")))
        return F.concat(state, F.array(F.array_max(ways)))

    paths = grouped.select("word", F.aggregate(F.sequence(F.lit(1), size), begin, step).alias("path"))
    at_end = F.struct(F.length("word").alias("at"), F.array().cast("array<int>").alias("ids"))

    def back(state, _):
        here = F.get(F.col("path"), state["at"])
        return F.when(state["at"] == 0, state).otherwise(F.struct(here["s"].alias("at"), F.concat(here["ids"], state["ids"]).alias("ids")))

    return paths.select("word", F.aggregate(F.sequence(F.lit(1), size), at_end, back)["ids"].alias("ids"))


def encode_words(words: list[str], model: Model) -> list[list[int]]:
    """The same lattice and fold over arrays, for all words side by side."""
    if not words:
        return []
    keys, ids, scores = _piece_hashes(model)
    seen = _bitmap(keys)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    out: list[list[int]] = [[]] * len(words)
    # Words of like length together, and no more than FOLD_CHARS characters at once.
    a = 0
    while a < len(order):
        top = lengths[order[a]]
        b = int(np.searchsorted(lengths[order], max(top + 2, top * 5 // 4), side="right"))
        b = max(a + 1, min(b, a + FOLD_CHARS // max(1, int(lengths[order[b - 1]]))))
        part = order[a:b].tolist()
        for k, got in zip(part, _fold([words[k] for k in part], model, keys, ids, scores, seen), strict=True):
            out[k] = got
        a = b
    return out


def _code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


def _prefix_sums(points: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + U(1)) * _power(_BASE, len(points)), out=sums[1:], dtype=np.uint64)
    return sums


_tables: dict[int, tuple] = {}


def _piece_hashes(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if id(model) not in _tables:
        names = list(model.pieces)
        sums = _prefix_sums(_code_points(names))
        ends = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)))
        starts = np.concatenate([[0], ends[:-1]])
        keys = mix((sums[ends] - sums[starts]) * _power(_INVERSE, int(ends[-1]) + 1)[starts])
        order = np.argsort(keys)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have the same hash")
        got = [model.pieces[n] for n in names]
        _tables[id(model)] = keys[order], np.array([g[0] for g in got], np.int64)[order], np.array([g[1] for g in got])[order]
    return _tables[id(model)]


def _bitmap(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << 20, bool)
    seen[(keys >> U(44)).astype(np.int64)] = True
    return seen


def _fold(words: list[str], model: Model, keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, seen: np.ndarray) -> list[list[int]]:
    n = len(words)
    points = _code_points(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    first = np.cumsum(lengths) - lengths
    sums = _prefix_sums(points)
    inverse = _power(_INVERSE, len(points) + 1)
    widest = int(lengths.max())
    inner_mark = points == ord(MARK)
    inner_mark[first] = False
    bytes_of = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    best = np.full((n, widest + 1), -np.inf)
    best[:, 0] = 0.0
    origin = np.zeros((n, widest + 1), np.int32)
    chosen = np.full((n, widest + 1), -1, np.int32)
    for e in range(1, widest + 1):
        live = np.flatnonzero(lengths >= e)
        base = first[live]
        # The later start wins a tie, so lengths go up and only a better score replaces.
        for size in range(1, min(e, model.longest) + 1):
            at = base + (e - size)
            key = mix((sums[at + size] - sums[at]) * inverse[at])
            hit = np.flatnonzero(seen[(key >> U(44)).astype(np.int64)] & ~inner_mark[at])
            place = np.minimum(np.searchsorted(keys, key[hit]), len(keys) - 1)
            true = keys[place] == key[hit]
            hit, place = hit[true], place[true]
            if size == 1:
                spelt = np.ones(len(live), bool)
                spelt[hit] = False
                rows = live[spelt]
                best[rows, e] = best[rows, e - 1] + BYTE_SCORE * bytes_of[at[spelt]]
                origin[rows, e] = e - 1
            rows = live[hit]
            way = best[rows, e - size] + scores[place]
            more = way > best[rows, e]
            rows = rows[more]
            best[rows, e] = way[more]
            origin[rows, e] = e - size
            chosen[rows, e] = ids[place[more]]
    out = []
    origin_l, chosen_l = origin.tolist(), chosen.tolist()
    for k, word in enumerate(words):
        e, back, piece, path = len(word), origin_l[k], chosen_l[k], []
        while e:
            s = back[e]
            if piece[e] >= 0:
                path.append(piece[e])
            else:
                path.extend(model.byte_ids[x] for x in reversed(word[s:e].encode("utf-8", "surrogatepass")))
            e = s
        path.reverse()
        out.append(path)
    return out


def encode_texts(texts: pa.Array, model: Model, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids of each)."""
    texts = texts.fill_null("")
    words, bounds = _cut(texts)
    index, names = distinct(words)
    marked = [_marked(w) for w in names]
    lists = [known.get(w) for w in marked]
    new = [k for k, x in enumerate(lists) if x is None]
    for k, got in zip(new, encode_words([marked[k] for k in new], model), strict=True):
        lists[k] = got
    per, ids = spread(index.astype(np.int64), *flatten(lists))
    counts = per_document(per, bounds)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(bool)
    if empty.any():  # an empty text has no mark either
        owner = np.repeat(np.arange(len(counts)), counts)
        ids = ids[~empty[owner]]
        counts[empty] = 0
    return ids, counts


def decode_ids(ids: np.ndarray, counts: np.ndarray, model: Model) -> list[bytes]:
    """UTF-8 of each document: pieces' surfaces in turn, without the first blank."""
    lengths, values = flatten(model.surfaces)
    per, data = spread(ids, lengths, values)
    ends = np.cumsum(per_document(per, np.concatenate([[0], np.cumsum(counts)])))
    raw = data.astype(np.uint8).tobytes()
    begins = np.concatenate([[0], ends[:-1]])
    return [raw[a + 1 : b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


def _pieces_of(column: pa.Array) -> Iterator[tuple[int, int]]:
    lengths = np.cumsum(pc.binary_length(column.fill_null("")).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(lengths, (lengths[a - 1] if a else 0) + CHUNK_BYTES, side="right")))
        yield a, b
        a = b


def _count_words(share: int):
    """Words that make up at least 1/share of a task's words, with their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            total = 0
            for a, b in _pieces_of(batch.column(0)):
                words, _ = _cut(batch.column(0).slice(a, b - a).fill_null(""))
                found = pc.value_counts(words)
                total += len(words)
                often = found.filter(pc.greater(found.field(1), max(1, len(words) // share)))
                for w, c in zip(often.field(0).to_pylist(), often.field(1).to_pylist(), strict=True):
                    counts[_marked(w)] += c
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64()), "total": pa.array([total] + [0] * (len(counts) - 1) if counts else [], pa.int64())}
            )

    return run


def frequent_words(docs: DataFrame, path: str, text: str = "text", share: int = FREQUENT) -> dict[str, list[int]]:
    """Ids of words that make up 1/share of all words, at most ``share`` of them, by the relational form."""
    counted = docs.select(F.col(text).alias("text")).mapInArrow(trimmed(_count_words(share)), "word string, n long, total long")
    counted = materialise(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "piece-words")
    total = counted.agg(F.sum("total")).first()[0] or 0
    words = counted.filter(F.col("n") * share >= total).select("word")
    return {r["word"]: list(r["ids"]) for r in word_ids_relational(words, path).collect()}


def _encode(path: str, known, with_ids: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path)
        for batch in batches:
            for a, b in _pieces_of(batch.column(1)):
                texts = batch.column(1).slice(a, b - a)
                ids, counts = encode_texts(texts, model, known.value)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                plain = decode_ids(ids, counts, model)
                exact = [x == (t.as_py() or "").encode("utf-8", "surrogatepass") for x, t in zip(plain, texts, strict=True)]
                out = {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_pieces": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                    "decoded_bytes": pa.array([len(x) for x in plain], pa.int64()),
                    "decoded_crc32": pa.array([zlib.crc32(x) for x in plain], pa.int64()),
                    "exact": pa.array(exact),
                }
                for c in keep:
                    out[c] = batch.column(c).slice(a, b - a)
                if with_ids:
                    bounds = np.concatenate([[0], ends]).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_bytes, decoded_crc32, exact (then ``keep``, and ids): a row for each input row."""
    spark: SparkSession = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent_words(docs, path, text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep)
    schema = T.StructType.fromDDL("doc_id long, n_pieces long, ids_crc32 long, decoded_bytes long, decoded_crc32 long, exact boolean")
    for c in keep:
        schema.add(docs.schema[c])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(trimmed(_encode(path, known, with_ids, list(keep))), schema)
