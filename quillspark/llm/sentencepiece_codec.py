"""SentencePiece encoding and decoding through tables of distinct chunks.

In the BPE models meant here no piece holds a white-space mark after another character, so pieces cannot cross from one
marked word into the next. Every slice of documents is cut into chunks (a run of marks and the word after it), each
distinct chunk is segmented once and its ids are decoded once, and both are joined back to the documents by position, ids
as numpy gathers over a flat table. Chunks met before stay in a bounded table of the Python worker. Nothing is shuffled. A model in which pieces do
cross marks, or that normalises its input, is run on whole texts instead.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices, per_worker, texts

#: Chunks kept in each Python worker's table; it is emptied when full.
CHUNK_TABLE = 300_000
MARK = "▁"
_CHUNK = re.compile(r" *[^ ]+| +")


class ChunkCodec:
    """ids and decoded texts, exactly as the library gives them for whole texts with begin and end ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = np.uint32(self.model.bos_id()), np.uint32(self.model.eos_id())
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = " a  b\tc\n ① "
        whole = self.model.encode(probe)
        self.free = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.decode(whole) == probe and self.model.encode("a", out_type=str)[0].startswith(MARK)
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self):
        self.known.clear()
        self.surfaces: list[str] = []
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _learn(self, chunks: list[str]):
        """Segments the chunks: those of one mark and a word as one text of words, as its pieces start where marks are."""
        words = [c for c in chunks if c[1:] and c[1] != " "]
        odd = [c for c in chunks if not c[1:] or c[1] == " "]
        joined = ["".join(words[i : i + 32])[1:] for i in range(0, len(words), 32)]
        ids = np.array([i for x in self.model.encode(joined, num_threads=1) for i in x], np.uint32)
        starts = np.flatnonzero(self.marked[ids])
        # a mark before the chunk is what the library adds itself
        more = [self.model.encode(c[1:], num_threads=1) if c != " " else [self.model.piece_to_id(MARK)] for c in odd]
        ends = [*starts[1:], *[len(ids)] * bool(words), *(len(ids) + np.cumsum([len(x) for x in more]))]
        if len(ends) != len(chunks):
            raise ValueError("the library split marked words otherwise than at their marks")
        self.known.update(zip(words + odd, range(len(self.known), len(self.known) + len(chunks))))
        self.flat, old = np.concatenate([self.flat, ids, *(np.array(x, np.uint32) for x in more)]), len(self.flat)
        self.starts = np.concatenate([self.starts, old + np.array(ends, np.int64)])
        # the library takes the mark off that it puts before a text
        at = self.starts[-len(ends) - 1 :].tolist()
        flat = self.flat.tolist()
        # where the text that comes out is the chunk, one string serves as both
        self.surfaces += [c if c[1:] == x else " " + x for c, x in zip(words + odd, self.model.decode([flat[i:j] for i, j in zip(at, at[1:])], num_threads=1))]

    def encode(self, batch: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids and decoded text of each text."""
        if not self.free:
            ids = self.model.encode(batch, add_bos=True, add_eos=True, num_threads=1)
            return [(np.array(x, np.uint32), self.model.decode(x)) for x in ids]
        if len(self.known) > CHUNK_TABLE:
            self._reset()
        cut = [self.chunks(t) for t in batch]
        new = {c for cs in cut for c in cs if c not in self.known}
        if new:
            self._learn(list(new))
        out = []
        for cs in cut:
            at = np.fromiter(map(self.known.__getitem__, cs), np.int64, len(cs))
            first, size = self.starts[at], self.starts[at + 1] - self.starts[at]
            ends = np.cumsum(size)
            step = np.ones(int(ends[-1]) if len(at) else 0, np.int64)
            if len(at):
                step[0] = first[0]
                step[ends[:-1]] = first[1:] - (first[:-1] + size[:-1] - 1)
            ids = np.concatenate([[self.bos], self.flat[np.cumsum(step)], [self.eos]]).astype(np.uint32)
            out.append((ids, "".join(map(self.surfaces.__getitem__, at.tolist()))[1:]))
        return out

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks with their marks as blanks; the first has the mark that the library puts before a text."""
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        if "  " not in text and text[-1] != " ":
            return [" " + w for w in text[1:].split(" ")]
        return _CHUNK.findall(text)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, n_tokens (all ids, begin and end among them), ids_sha256 over little-endian unsigned
    32-bit ids, decoded_sha256 over the decoded text; with_ids adds `ids`, with_text `decoded`, keep further columns.

    A null text is read as empty, and so gives the begin and end ids and an empty text. Repeated rows and null ids keep
    their rows. An empty table gives an empty result. Columns of docs that aren't named in keep are dropped, so that
    names cannot clash. Long texts are encoded whole.
    """
    codec = per_worker(lambda: ChunkCodec(model_path))
    keep = [c for c in keep or [] if c != id_col]
    kinds = dict(docs.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = codec().encode([t.decode() if t else "" for t in texts(batch, text_col)])
        out = {c: batch.column(c) for c in [id_col, *keep]}
        out["n_tokens"] = pa.array([len(x) for x, _ in found], pa.int64())
        out["ids_sha256"] = pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x, _ in found])
        out["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for _, x in found])
        if with_ids:
            out["ids"] = pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32()))
        if with_text:
            out["decoded"] = pa.array([x for _, x in found], pa.string())
        return pa.record_batch(out)

    return map_slices(docs.select(id_col, *keep, *([] if text_col in keep else [text_col])), text_col, make, schema, limit=2 << 20)
