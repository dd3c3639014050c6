"""Token-ID files with fixed-width bit packing.

Documents are put in ascending order of their ids by a range shuffle, encoded, and written as blocks: rows of a Parquet
table (Spark's committer makes the write safe against lost executors, and every file system that Spark knows will do). A
block holds whole documents with about BLOCK_TOKENS ids; its payload stores each id in the fewest bits that hold the
vocabulary, most significant bit first, padded to a byte at the end. Columns of a block:

    part, block        range partition, number within it; their order is the order of ids
    bits               width of an id
    first              ids of the same part before the block
    n_tokens           ids in the block
    doc_ids, doc_at    its documents, and where each begins in the block
    payload            the packed ids

The global place of an id is the sum of all earlier parts' ids plus `first` plus its place in the block, so blocks can be written
without knowing each other, and a reader finds a place by the block table alone and unpacks only that block.

Defined cases: a null text counts as empty (its ids are the end id alone); null document ids come first; equal ids are
ordered by the hash of their texts; repeated rows are written each; an empty table gives files without blocks;
other columns are ignored. A text of any length is one document of one block.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointlens.llm.common import text_slices

SLICE_BYTES = 1 << 21
BLOCK_TOKENS = 1 << 16
CACHE_WORDS = 200_000  # of a generation; bounds the memory of a task


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits, most significant first."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> shifts) & 1).astype(np.uint8)).tobytes()


def unpack(payload: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """Ids start to start + n of a packed payload, as uint32; only the bytes that hold them are read."""
    if bits == 16:
        return np.frombuffer(payload, ">u2", n, 2 * start).astype(np.uint32)
    low, high = start * bits // 8, -(-(start + n) * bits // 8)
    flags = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low))[start * bits - 8 * low :][: n * bits]
    return flags.reshape(n, bits) @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


#: Fixed value: the word pattern of the lower-casing vocabulary.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_BETWEEN = regex.compile(PIECES.pattern + "| ")  # the same over pieces with single spaces between them


class WordEncoder:
    """Encodes with the tokenizers library, each word once while it is remembered.

    The library's words never span ASCII white space, so a text is the sum of its pieces between it. Where the tokenizer lower-cases and
    cuts by PIECES, a piece is the sum of its lower-case words, which go to the library's model without being normalised and cut again;
    pieces that normalising could change otherwise are left to the library as they are.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        suffix = parsed["model"].get("end_of_word_suffix")
        self.cuts = bool(suffix) and self._cuts(parsed)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # which tokens end a word
        if self.cuts:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            letters = parsed["pre_tokenizer"]["pretokenizers"][-1]
            bare = {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, letters]}, "added_tokens": []}
            self.model = Tokenizer.from_str(json.dumps(parsed | bare))
            self.model.no_truncation()
            self.model.no_padding()
        self.library.no_truncation()
        self.library.no_padding()
        special = [(t.content, i) for i, t in self.library.get_added_tokens_decoder().items() if t.special]
        self.border, self.border_id = special[0] if special else (None, None)
        self.young: dict[str, bytes] = {}  # ids of pieces; two generations, so that those that come again stay
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _cuts(spec: dict) -> bool:
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        patterns = [s["pattern"].get("Regex", "").replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}") for s in steps if s["type"] == "Split"]
        kinds = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        bytewise = [s["type"] for s in steps][-1:] == ["ByteLevel"]
        return patterns == [PIECES.pattern] and bytewise and kinds == ["NFC", "Replace", "Lowercase"] and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))

    def _plain(self, piece: str) -> bool:
        """Whether normalising a piece is lower-casing it."""
        if not self.cuts or "<|" in piece or not piece.isprintable():
            return False
        if piece.isascii():
            return True
        return "Σ" not in piece and "İ" not in piece and unicodedata.is_normalized("NFC", piece) and unicodedata.is_normalized("NFC", piece.lower())

    def _ids(self, library, text: str) -> np.ndarray:
        return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words, in one call of the library: set apart by spaces, each one ends with the only token that ends a word."""
        ids = self._ids(self.model, " ".join(words))
        at = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(at) != len(words):
            raise RuntimeError("the tokenizer's words do not end as its file says")
        data = ids.tobytes()
        return [data[s:e] for s, e in zip([0, *at], at)]

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of any pieces, set apart by a special token in one call; those that hold it go one by one."""
        joint = [p for p in pieces if self.border is not None and self.border not in p]
        out = {p: self._ids(self.library, p).tobytes() for p in set(pieces).difference(joint)}
        if joint:
            ids = self._ids(self.library, self.border.join(joint))
            at = (4 * np.flatnonzero(ids == self.border_id)).tolist()
            data = ids.tobytes()
            out |= zip(joint, [data[s:e] for s, e in zip([0, *(a + 4 for a in at)], [*at, len(data)])])
        return out

    def _learn(self, pieces: list[str]) -> None:
        whole = [p for p in pieces if self.cuts and p.isascii() and p.isalpha()]  # one word each
        other = [p for p in pieces if not (self.cuts and p.isascii() and p.isalpha())]
        cut = [p for p in other if self._plain(p)]
        words = _BETWEEN.findall(" ".join(cut).lower())
        border = np.flatnonzero(np.fromiter((w == " " for w in words), bool, len(words))).tolist()
        parts = [words[s:e] for s, e in zip([0, *(b + 1 for b in border)], [*border, len(words)])] if cut else []
        lower = [p.lower() for p in whole]
        known = self.words
        new = [w for w in dict.fromkeys([*lower, *words]) if w not in known and w != " "]
        if new:
            known.update(zip(new, self._encode_words(new)))
        self.young.update(zip(whole, map(known.__getitem__, lower)))
        self.young.update(zip(cut, [known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps]) for ps in parts]))
        self.young.update(self._encode_pieces(list(set(other).difference(cut))))

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        new = []
        for p in pieces:
            if p not in young:
                if p in old:
                    young[p] = old[p]
                else:
                    new.append(p)
        if new:
            if len(self.words) > CACHE_WORDS:
                self.words = {}
            self._learn(new)
        found = [*map(young.__getitem__, pieces)]
        if len(young) > CACHE_WORDS:
            self.young, self.old = {}, young
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a LargeBinary or LargeString array without nulls: each different piece of the slice is looked up once."""
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        ends = cut.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(cut.values.slice(ends[0], ends[-1] - ends[0]))
        entries = pa.array(self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        taken = entries.take(coded.indices)
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4")
        stops = (offsets[ends - ends[0]] // 4).tolist()
        return [ids[s:e] for s, e in zip(stops, stops[1:])]


_encoders: dict[str, WordEncoder] = {}  # a worker keeps its encoder for its next tasks


def encoder_for(spec: str) -> WordEncoder:
    if spec not in _encoders:
        _encoders.clear()
        _encoders[spec] = WordEncoder(spec)
    return _encoders[spec]


def vocabulary_bits(spec: str) -> int:
    from tokenizers import Tokenizer

    return max(1, (Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True) - 1).bit_length())


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS
) -> None:
    """Encode docs with the tokenizer file (a path on the driver) and write the blocks to `path`, which any executor can reach."""
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    bits = vocabulary_bits(text)
    spec = docs.sparkSession.sparkContext.broadcast(text)
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    kind = docs.schema[id_col].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        encoder, ids, owners, held = None, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, first, ids, owners, held
            at = np.concatenate([[0], np.cumsum([len(i) for i in ids])[:-1]]).astype(np.int32)
            row = {"part": part, "block": number, "bits": bits, "first": first, "n_tokens": held, "doc_ids": pa.concat_arrays(owners), "doc_at": at, "payload": pack(np.concatenate(ids), bits)}
            number, first, ids, owners, held = number + 1, first + held, [], [], 0
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]], pa.int32()),
                    pa.array([row["block"]], pa.int32()),
                    pa.array([row["bits"]], pa.int32()),
                    pa.array([row["first"]], pa.int64()),
                    pa.array([row["n_tokens"]], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(row["doc_ids"])], pa.int32()), row["doc_ids"]),
                    pa.array([row["doc_at"]], pa.list_(pa.int32())),
                    pa.array([row["payload"]], pa.binary()),
                ],
                list(row),
            )

        for batch in batches:
            for rows, texts in text_slices(batch, "_text", SLICE_BYTES):
                encoder = encoder or encoder_for(spec.value)
                for i, own in enumerate(encoder.encode(texts)):
                    ids.append(np.concatenate([own, tail]))
                    owners.append(rows.column("_id").slice(i, 1))
                    held += len(ids[-1])
                    if held >= block_tokens:
                        yield close()
        if owners:
            yield close()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .withColumns({"_tie": F.xxhash64("_text"), "_n": F.monotonically_increasing_id()})
        .repartitionByRange(n, "_id", "_tie", "_n")  # a number of its own, so that equal rows can be split
        .sortWithinPartitions("_id", "_tie", "_n")
        .select("_id", "_text")
    )
    schema = f"part int, block int, bits int, first long, n_tokens long, doc_ids array<{kind}>, doc_at array<int>, payload binary"
    ordered.mapInArrow(blocks, schema).write.parquet(path)


def _part_starts(blocks: DataFrame) -> DataFrame:
    """_part, _before: ids in earlier parts. One row for each part, of which there are as many as shuffle partitions at most."""
    totals = blocks.groupBy(F.col("part").alias("_part")).agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))


def block_table(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `start`, the global place of their first id."""
    blocks = spark.read.parquet(path)
    return blocks.join(F.broadcast(_part_starts(blocks)), F.col("part") == F.col("_part")).withColumn("start", F.col("_before") + F.col("first")).drop("_part", "_before")


def read_tokens(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """place, ids: ids start to start + n of the whole corpus, a row for each block that holds some of them. Other blocks' payloads are not read."""
    blocks = block_table(spark, path).where((F.col("start") < start + n) & (F.col("start") + F.col("n_tokens") > start))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                low, high = max(start, b["start"]), min(start + n, b["start"] + b["n_tokens"])
                ids = unpack(b["payload"], b["bits"], high - low, low - b["start"])
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([ids], pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))], ["place", "ids"])

    return blocks.select("start", "bits", "n_tokens", "payload").mapInArrow(cut, "place long, ids array<int>")


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, start (ids of all documents before it), n_tokens and ids_crc32 (of its ids as little-endian uint32), from the files alone."""
    blocks = block_table(spark, path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = {c: batch.column(c)[row] for c in batch.schema.names}
                n, begin = b["n_tokens"].as_py(), b["start"].as_py()
                ids = unpack(b["payload"].as_py(), b["bits"].as_py(), n).astype("<u4")
                at = np.append(b["doc_at"].values.to_numpy(), n).astype(np.int64)
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([b["doc_ids"].values, pa.array(begin + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    rows = blocks.select("start", "bits", "n_tokens", "doc_ids", "doc_at", "payload")
    return rows.mapInArrow(each, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")
