"""Token files: Arrow IPC files whose record batches are fixed-size lists.

A shard holds the ids of its documents, in ascending doc_id order, as one stream cut into sequences of
``seq_len``: ``shard-N.arrow`` with columns input_ids (fixed-size list of uint16, or uint32 for
vocabularies over 65,536) and mask (fixed-size list of bool, false where the last sequence is padded),
and ``shard-N.docs.arrow`` with doc_id, start and n_tokens. All batches but the last hold
the same number of sequences, so sequence i lies at a computed place; files are not compressed, and a
memory map gives arrays without a copy.

Cases: null text is an empty document (only the end id); null doc_ids come first; rows that repeat a
doc_id are written one after the other, by their texts; a text of any length is encoded whole; other columns are ignored, whatever
their names; an empty table gives empty shards. Shards are as many as Catalyst's estimate of the table's bytes asks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import parts_for
from quarry.llm.files import opened, place
from quarry.llm.tokens import encoder

#: Sequences in a batch.
BATCH = 256


def _ids_type(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def _lists(flat: np.ndarray, seq_len: int, n: int) -> pa.RecordBatch:
    rows = -(-n // seq_len)
    flat = np.concatenate([flat, np.zeros(rows * seq_len - len(flat), flat.dtype)]) if len(flat) < rows * seq_len else flat
    mask = np.arange(rows * seq_len) < n
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), seq_len)], ["input_ids", "mask"])


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, spaced: bool = True, end_id: int = 2, seq_len: int = 2048, shards: int | None = None) -> list[tuple[int, int, int]]:
    """Writes docs to uri; returns (shard, documents, tokens) of each shard, which is all that reaches the driver."""
    n = shards or parts_for(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, shard = encoder(tokenizer, spaced), TaskContext.get().partitionId()
        encode, kind = made.encode, _ids_type(made.model.get_vocab_size())
        schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(kind), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))], metadata={"end_id": str(end_id)})
        ids, sizes, full = [], [], BATCH * seq_len

        def write(out: pa.NativeFile) -> None:
            held, count = [], 0
            with ipc.new_file(out, schema) as file:
                for b in batches:
                    texts = b.column("text").to_pylist()
                    ids.append(b.column("doc_id"))
                    for k in range(0, len(texts), 256):
                        for x in encode(texts[k : k + 256]):
                            sizes.append(len(x) + 1)
                            held += [x.astype(kind), np.array([end_id], kind)]
                            count += len(x) + 1
                        if count >= full:
                            flat = np.concatenate(held)
                            whole = count // full * full
                            for at in range(0, whole, full):
                                file.write_batch(_lists(flat[at : at + full], seq_len, full))
                            held, count = [flat[whole:]], count - whole
                if count:
                    file.write_batch(_lists(np.concatenate(held), seq_len, count))

        place(uri, f"shard-{shard}.arrow", write)
        size = np.array(sizes, np.int64)
        index = pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "start": pa.array(np.cumsum(size) - size), "n_tokens": pa.array(size)})

        def write_index(out: pa.NativeFile) -> None:
            with ipc.new_file(out, index.schema) as file:
                file.write_table(index)

        place(uri, f"shard-{shard}.docs.arrow", write_index)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(size), int(size.sum()))], ["shard", "documents", "tokens"])

    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    done = ordered.mapInArrow(run, "shard long, documents long, tokens long").collect()
    return sorted((r.shard, r.documents, r.tokens) for r in done)


class TokenShard:
    """Random access to one shard. On a local folder the file is memory-mapped and arrays are views of it."""

    def __init__(self, uri: str, shard: int) -> None:
        from pyarrow import fs

        store, folder = opened(uri)
        path = f"{folder}/shard-{shard}"
        open_ = (lambda p: pa.memory_map(p)) if isinstance(store, fs.LocalFileSystem) else store.open_input_file
        self.file = ipc.open_file(open_(f"{path}.arrow"))
        self.docs = ipc.open_file(open_(f"{path}.docs.arrow")).read_all()
        self.seq_len = self.file.schema.field("input_ids").type.list_size

    def batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        b = self.file.get_batch(k)
        return b.column(0).flatten().to_numpy(zero_copy_only=True).reshape(-1, self.seq_len), b.column(1)

    def sequence(self, i: int) -> np.ndarray:
        """Sequence i's ids, as a view."""
        return self.batch(i // BATCH)[0][i % BATCH]

    def mask(self, i: int) -> pa.Array:
        return self.batch(i // BATCH)[1][i % BATCH].values

    def document(self, k: int) -> np.ndarray:
        """Document k's ids with the end id."""
        start, n = self.docs["start"][k].as_py(), self.docs["n_tokens"][k].as_py()
        full = BATCH * self.seq_len
        parts = [self.batch(b)[0].ravel()[max(0, start - b * full) : start + n - b * full] for b in range(start // full, (start + n - 1) // full + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_index(spark: SparkSession, uri: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """Per document, from the files: doc_id, start (in the whole corpus), n_tokens and ids_crc32. A task a shard, batch by batch."""
    first, at = {}, 0
    for shard, _, tokens in shards:
        first[shard] = at
        at += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                if shard not in first:
                    continue
                file = TokenShard(uri, shard)
                sizes = file.docs["n_tokens"].to_numpy()
                crcs, k, got, crc = np.zeros(len(sizes), np.int64), 0, 0, 0
                for j in range(file.file.num_record_batches):
                    flat = file.batch(j)[0].ravel().astype("<u4")
                    i = 0
                    while i < len(flat) and k < len(sizes):
                        take = min(int(sizes[k]) - got, len(flat) - i)
                        crc = zlib.crc32(flat[i : i + take], crc)
                        got, i = got + take, i + take
                        if got == sizes[k]:
                            crcs[k] = crc
                            k, got, crc = k + 1, 0, 0
                start = file.docs["start"].to_numpy() + first[shard]
                for k in range(0, len(sizes), 50_000):
                    yield pa.RecordBatch.from_arrays([file.docs["doc_id"].combine_chunks()[k : k + 50_000], pa.array(start[k : k + 50_000]), pa.array(sizes[k : k + 50_000]), pa.array(crcs[k : k + 50_000])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, max(first, default=0) + 1)
    return spark.range(0, n, 1, n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
