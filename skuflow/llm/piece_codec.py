"""SentencePiece encoding and decoding over a distinct-chunk table.

No piece of the model has a whitespace marker behind another character, so no
merge crosses the border between a character and a marker. A marked text
(``U+2581`` for each space, one more in front) is therefore cut into chunks - a
run of markers and the characters up to the next marker - and the ids of the
text are the ids of its chunks one after the other. Each task keeps a table
``chunk -> ids``: a batch's chunks are looked up, the distinct ones not yet in
the table go through the library together, once, and the ids are joined back by
position. Words repeat, so the library segments a small part of the text.

The table belongs to a task rather than to the job: a global table would have
to meet the text again in a shuffle of all chunk occurrences (about two to
three times the input), whereas here nothing is shuffled, no key can be hot
and a lost task is simply run again. The table holds at most
``table_entries`` chunks and starts afresh beyond; that changes the work, never
the ids.

Models to which the rule does not apply (a piece with an inner marker, another
normaliser than identity, no marker in front, user-defined symbols) are encoded
text by text.

Defined cases: a null text counts as empty and has only the begin and end ids;
ids may be null or repeated (they are not looked at); further columns are
dropped, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.llm.common import bound_batches, strings, text_slices

MARK = "▁"
TABLE_ENTRIES = 100_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunks_of(text: str) -> list[str]:
    """The text cut before each run of markers; every chunk lacks its first marker."""
    if MARK in text or "  " in text or text.startswith(" ") or text.endswith(" "):
        marked = MARK + text.replace(" ", MARK)
        return [c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", marked)]
    return text.split(" ") if text else []


def splits_at_markers(processor) -> bool:
    """Whether the model's pieces never cross a marker, so that chunks can be encoded alone."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(processor.serialized_model_proto())
    norm, trainer = model.normalizer_spec, model.trainer_spec
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
    return bool(plain and norm.escape_whitespaces and trainer.byte_fallback
                and not trainer.treat_whitespace_as_suffix and processor.piece_to_id(MARK) != processor.unk_id()
                and all(MARK not in p.piece.lstrip(MARK) and p.type != 4 for p in model.pieces))


class ChunkTable:
    """Chunk -> ids of one task; see the module's docstring."""

    def __init__(self, model_path: str, table_entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunked = splits_at_markers(self.processor)
        self.mark = self.processor.piece_to_id(MARK)
        self.limit, self.ids = table_entries, {"": [self.mark]}  # a single marker at the end of a text
        self.begin, self.end = self.processor.bos_id(), self.processor.eos_id()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.chunked:
            ids = self.processor.encode(texts, add_bos=True, add_eos=True, num_threads=1)
            return [np.asarray(x, dtype="<u4").tobytes() for x in ids]
        out = []
        for _, part in text_slices(texts, 500_000):
            cut = [chunks_of(t) for t in part]
            if len(self.ids) > self.limit:
                self.ids = {"": [self.mark]}
            missing = list(set(chain.from_iterable(cut)) - self.ids.keys())
            if missing:
                self.ids.update(zip(missing, self.processor.encode(missing, num_threads=1), strict=True))
            look = self.ids.__getitem__
            for chunks in cut:
                ids = array("I", (self.begin,))
                ids.extend(chain.from_iterable(map(look, chunks)))
                ids.append(self.end)
                out.append(np.asarray(ids, dtype="<u4").tobytes())
        return out


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None,
           table_entries: int = TABLE_ENTRIES) -> DataFrame:
    """``(id_col, ids)``: ids of the whole text with begin and end, as little-endian uint32 bytes."""
    bound_batches(df.sparkSession)
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = table or ChunkTable(path, table_entries)
            ids = pa.array(table.encode(strings(batch.column(1))), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """``(id_col, ids, decoded)``: the text that the library's ``decode(ids)`` gives."""
    bound_batches(df.sparkSession)
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = None
        for batch in batches:
            processor = processor or sentencepiece.SentencePieceProcessor(model_file=path)
            texts = [processor.decode(np.frombuffer(b or b"", dtype="<u4").tolist()) if b else ""
                     for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=[id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(
        run, f"`{id_col}` {kind}, ids binary, decoded string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None,
               table_entries: int = TABLE_ENTRIES) -> DataFrame:
    """``(id_col, ids, decoded)``: ``encode`` and ``decode`` in one pass, so that a task has one Python worker."""
    bound_batches(df.sparkSession)
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = table or ChunkTable(path, table_entries)
            ids = table.encode(strings(batch.column(1)))
            texts = [table.processor.decode(np.frombuffer(b, dtype="<u4").tolist()) for b in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                                             names=[id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded string")


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token counts and digests of ids and decoded text (what ``op1`` reports)."""
    return coded.select(
        F.col(id_col),
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
