"""Operator 7: token ids as compressed binary files, with direct access by document.

A set of files at ``path`` has three Parquet tables, so that any store Spark can
reach will do:

``dictionary``  one row: dict_hash, the trained zstandard dictionary (may be empty)
``segments``    runs of documents in ascending order: part, segment, before (ids
                in the part before it), first_id, last_id, dict_hash, width, the arrays doc_ids, n_tokens, ends,
                and payload, the documents' frames one after another
``parts``       part, base: the ids in all parts before it

A document is its ids as little-endian unsigned integers of ``width`` bytes, in
one zstandard frame of its own made with the shared dictionary. ``ends`` is the
offset index into ``payload``.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyscape.llm import lean
from keyscape.llm.memo import safe_pieces, tokenizer_memo
from keyscape.llm.words import flat, ragged
from keyscape.session import durable_dir

SAMPLE_DOCS = 1000
SAMPLE_CHARS = 16_384
DICT_BYTES = 65_536
SEGMENT_BYTES = 1 << 20
PART_BYTES = 32 << 20
LEVEL = 3


def _tokens(tokenizer: str, column: pa.Array, end_id: int, folds: bool) -> Iterator[np.ndarray]:
    """Ids of every row, each with ``end_id`` after it."""
    memo = tokenizer_memo(tokenizer, ids=True)
    data, off = flat(column)
    row, part = 0, []
    for base, starts, ends, keys in safe_pieces(data, off, folds, memo.added):
        slots = memo.resolve(data, starts + base, ends - starts, keys)
        lengths = memo.lengths[slots]
        ids = memo.flat[ragged(memo.starts[slots], lengths)]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        done = 0
        while row < len(off) - 1 and off[row + 1] <= base + int(ends[-1]):
            at = int(upto[np.searchsorted(starts, max(off[row + 1] - base, 0))])
            yield np.concatenate([*part, ids[done:at], [end_id]]).astype(np.uint32)
            row, part, done = row + 1, [], at
        part.append(ids[done:])
    for _ in range(row, len(off) - 1):
        yield np.array([end_id], np.uint32)


def train_dictionary(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, folds: bool,
    width: int,
) -> bytes:
    """zstandard dictionary from a bounded sample: of the texts of at most
    ``SAMPLE_CHARS`` characters, the ``SAMPLE_DOCS`` of the smallest hash. It
    only affects the size of the files. Empty when there is too little text."""
    import zstandard

    sample = (
        docs.select(F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("h"))
        .where(F.length("t").between(1, SAMPLE_CHARS)).orderBy("h").limit(SAMPLE_DOCS)
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                x.astype(f"<u{width}").tobytes()
                for x in _tokens(tokenizer, batch.column(0), end_id, folds)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    rows = [bytes(r.ids) for r in sample.select("t").mapInArrow(encode, "ids binary").collect()]
    if len(rows) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


def _coder(kind, dictionary: bytes, **more):
    import zstandard

    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return getattr(zstandard, kind)(**shared, **more)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: list | None = None,
    folds: bool = False,
    width: int = 2,
    part_bytes: int = PART_BYTES,
) -> None:
    """Write the ids of every whole text of ``docs`` to token files at ``path``.

    Documents are in ascending order of the integer id (or by ``order``), dealt by
    range to parts of about ``part_bytes`` of text; ties are broken by the text,
    then by input position, so that no value of the id fills one part alone. Ids
    of one document are compressed together, so a document must fit in memory.
    ``width`` is 2 (vocabularies of up to 65,536) or 4. ``folds`` says that the
    tokenizer lower-cases and drops white space.

    A null or empty text is a document of the end id only. Null ids come first
    and are kept; repeated rows stay repeated; an empty table writes empty files.
    Other columns are not read.
    """
    spark = docs.sparkSession
    key = [F.col(c) if isinstance(c, str) else c for c in (order or [id_col])]
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"),
        *[c.alias(f"o{k}") for k, c in enumerate(key)],
        F.monotonically_increasing_id().alias("p"),
    )
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // part_bytes))
    by = [*[f"o{k}" for k in range(len(key))], F.xxhash64("t"), "p"]
    dictionary = train_dictionary(docs, tokenizer, end_id, id_col, text_col, folds, width)
    mark = zlib.crc32(dictionary)
    spark.createDataFrame([(mark, dictionary)], "dict_hash long, dictionary binary").coalesce(
        1).write.parquet(f"{path}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = _coder("ZstdCompressor", dictionary, level=LEVEL)
        number = before = 0
        ids, counts, ends, frames, held = [], [], [], [], 0

        def segment() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = {
                "part": part, "segment": number, "before": before, "first_id": min(known, default=None),
                "last_id": max(known, default=None), "dict_hash": mark, "width": width,
                "doc_ids": ids, "n_tokens": counts, "ends": ends, "payload": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=_SEGMENT)

        for batch in batches:
            for i, found in zip(
                batch.column(0).to_pylist(), _tokens(tokenizer, batch.column(1), end_id, folds),
                strict=True,
            ):
                frame = coder.compress(found.astype(f"<u{width}").tobytes())
                held += len(frame)
                ids.append(i)
                counts.append(len(found))
                ends.append(held)
                frames.append(frame)
                if held >= SEGMENT_BYTES:
                    yield segment()
                    number, before = number + 1, before + sum(counts)
                    ids, counts, ends, frames, held = [], [], [], [], 0
        if ids:
            yield segment()
        lean.give_back()

    packed = (
        rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("i", "t")
        .mapInArrow(pack, _SEGMENT_DDL)
    )
    packed.write.parquet(f"{path}/segments")
    segments = spark.read.schema(_SEGMENT_DDL).parquet(f"{path}/segments")
    tokens = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    # one row for each part: the driver holds a number for each written file
    sums = dict(segments.groupBy("part").agg(F.sum(tokens)).collect())
    bases, total = [], 0
    for part in sorted(sums):
        bases.append((part, total))
        total += sums[part]
    spark.createDataFrame(bases, "part int, base long").coalesce(1).write.parquet(f"{path}/parts")


_SEGMENT_DDL = (
    "part int, segment int, before long, first_id long, last_id long, dict_hash long, width int, "
    "doc_ids array<bigint>, n_tokens array<int>, ends array<int>, payload binary"
)
_SEGMENT = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("first_id", pa.int64()),
    ("last_id", pa.int64()), ("dict_hash", pa.int64()), ("width", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())),
    ("ends", pa.list_(pa.int32())), ("payload", pa.binary()),
])


def _dictionary(spark: SparkSession, path: str) -> tuple[int, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if zlib.crc32(bytes(row.dictionary)) != row.dict_hash:
        raise ValueError(f"the dictionary of {path} is damaged")
    return row.dict_hash, bytes(row.dictionary)


def _frames(row: dict, coder) -> Iterator[tuple[int | None, np.ndarray]]:
    start = 0
    for i, count, end in zip(row["doc_ids"], row["n_tokens"], row["ends"], strict=True):
        raw = coder.decompress(row["payload"][start:end], count * row["width"])
        yield i, np.frombuffer(raw, f"<u{row['width']}")
        start = end


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files;
    with ``ids`` also its ids as binary, 4 bytes each, little-endian."""
    mark, dictionary = _dictionary(spark, path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder("ZstdDecompressor", dictionary)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["dict_hash"] != mark:
                    raise ValueError("a segment was written with another dictionary")
                out = []
                for i, found in _frames(row, coder):
                    raw = found.astype("<u4").tobytes()
                    out.append((i, len(found), zlib.crc32(raw), raw))
                n = len(out)
                starts = np.cumsum([0, *[x[1] for x in out]])[:n] + row["before"]
                columns = [
                    pa.array([x[0] for x in out], pa.int64()), pa.array([row["part"]] * n, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([x[3] for x in out], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=out_names)

    out_names = ["doc_id", "part", "at", "n_tokens", "ids_crc32", *["ids"] * ids]
    segments = spark.read.schema(_SEGMENT_DDL).parquet(f"{path}/segments")
    rows = segments.select(
        "part", "before", "dict_hash", "width", "doc_ids", "n_tokens", "ends", "payload")
    found = rows.mapInArrow(
        lean.batches(unpack), "doc_id long, part int, at long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    parts = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    return found.join(parts, "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
        *["ids"] * ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents of one id: only segments whose id range holds it are
    read, and only its own frames decompressed. Files in ascending order only."""
    mark, dictionary = _dictionary(spark, path)
    coder = _coder("ZstdDecompressor", dictionary)
    found = []
    segments = spark.read.schema(_SEGMENT_DDL).parquet(f"{path}/segments")
    for row in segments.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).collect():
        if row.dict_hash != mark:
            raise ValueError("a segment was written with another dictionary")
        for k, i in enumerate(row.doc_ids):
            if i == doc_id:
                frame = bytes(row.payload)[row.ends[k - 1] if k else 0 : row.ends[k]]
                raw = coder.decompress(frame, row.n_tokens[k] * row.width)
                found.append(np.frombuffer(raw, f"<u{row.width}").tolist())
    return found


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared folder of the session."""
    return f"{durable_dir(spark)}/{label}-{uuid.uuid4().hex}"
