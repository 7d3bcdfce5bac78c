"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed and rebuilt: its normaliser, the marker that stands
for blanks, its pieces with unigram scores (or, for a BPE model, the merges that
the scores imply), user-defined pieces and byte fallback. Batches are encoded by
``threads`` threads of the library. Whatever is encoded or decoded for the first time
is held against the sentencepiece library.

Where no piece has the marker behind another sign, texts are cut before blanks and
each distinct chunk is encoded once by a worker; else, and for texts with runs of
blanks, whole texts are encoded. The library decodes each piece of the vocabulary once, when
the model is loaded, and each run of byte pieces, whose signs cross pieces; a text is
these one after the other. ``round_trip`` does both in one pass with one model a
worker.

Defined results: a null text counts as empty and has no ids; null ids decode to the
empty text; repeated rows give repeated results; an empty table gives no rows;
further columns are carried along, but one named like a result is replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemill.llm import words

MARK = "▁"
# Fixed values of the model format.
UNIGRAM, BPE = 1, 2
UNKNOWN, CONTROL, USER, BYTE = 2, 3, 4, 6
#: Threads of the library in a task; two keep a core busy while Python copies.
THREADS = 2


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Backend:
    """A SentencePiece model on the tokenizers library."""

    def __init__(self, path: str, threads: int = THREADS, verify: bool = True):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), str(threads > 1).lower()
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.proto = ModelProto()
        with open(path, "rb") as file:
            self.proto.ParseFromString(file.read())
        self.pieces = [p.piece for p in self.proto.pieces]
        self.kinds = [p.type for p in self.proto.pieces]
        self.prefix = self.proto.normalizer_spec.add_dummy_prefix
        self.tokenizer = self._build()
        self.native = SentencePieceProcessor(model_file=path) if verify else None
        apart = all(MARK not in p.lstrip(MARK) and k != USER for p, k in zip(self.pieces, self.kinds, strict=True) if k != CONTROL)
        plain = not self.proto.normalizer_spec.precompiled_charsmap and not self.proto.normalizer_spec.remove_extra_whitespaces
        # a run of blanks, a blank at the start, or the marker itself: the whole text is encoded
        whole = rf"^ |  |{MARK}" if apart and plain and self.prefix else r"(?s)^"
        self.encode = words.ChunkEncoder(lambda chunks: self._ids(chunks, [c[1:] for c in chunks]), lambda heads: self._ids([" " + h if h and self.prefix else h for h in heads], heads), whole)
        self.is_byte = np.array([k == BYTE for k in self.kinds])
        self.marked = np.array([p.startswith(MARK) for p in self.pieces])
        self.silent = np.array([k == CONTROL for k in self.kinds])
        self.surface = [b"" if k == CONTROL else x.encode() for k, x in zip(self.kinds, self.spell([[i] for i in range(len(self.pieces))], self.kinds), strict=True)]
        self.length = np.array([len(x) for x in self.surface])

    def _build(self):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        spec, train = self.proto.normalizer_spec, self.proto.trainer_spec
        fallback = BYTE in self.kinds
        number = {p: i for i, p in enumerate(self.pieces)}
        if train.model_type == UNIGRAM:
            unknown = self.kinds.index(UNKNOWN)
            model = models.Unigram([(p.piece, p.score) for p in self.proto.pieces], unknown, fallback)
        elif train.model_type == BPE:
            rank = {p.piece: -p.score for p in self.proto.pieces if p.type == 1}
            merges = [(rank[p], number[p[:k]], number[p[k:]], p[:k], p[k:]) for p in rank for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
            model = models.BPE(number, [(a, b) for *_, a, b in sorted(merges)], unk_token=self.pieces[self.kinds.index(UNKNOWN)], fuse_unk=True, byte_fallback=fallback)
        else:
            raise ValueError(f"model type {train.model_type} is neither unigram nor BPE")
        tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
        if spec.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        surface = [decoders.Replace(self.pieces[self.kinds.index(UNKNOWN)], train.unk_surface)] if UNKNOWN in self.kinds else []
        tokenizer.decoder = decoders.Sequence([*surface, decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        tokenizer.add_tokens([AddedToken(p, normalized=True) for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER])
        return tokenizer

    def _ids(self, given: list[str], plain: list[str]) -> list[list[int]]:
        """Ids of marked strings; ``plain`` are those that the native library would mark so."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(given, add_special_tokens=False)]
        if self.native is not None:
            check = [k for k, p in enumerate(plain) if p]
            for k, ids in zip(check, self.native.encode([plain[k] for k in check], num_threads=1), strict=True):
                if ids != found[k]:
                    raise ValueError(f"the libraries differ on {plain[k]!r}: {found[k]} and {ids}")
        return found

    def spell(self, runs: list[list[int]], kinds: list[int] | None = None) -> list[str]:
        """Each run of ids as the library decodes it, its blank at the start included. Control pieces have no text."""
        found = self.tokenizer.decode_batch(runs, skip_special_tokens=False)
        if self.native is not None:
            for k, (run, own, other) in enumerate(zip(runs, found, self.native.decode(runs), strict=True)):
                if kinds and kinds[k] == CONTROL:
                    own = ""
                if (own[1:] if self.prefix and self.pieces[run[0]].startswith(MARK) else own) != other:
                    raise ValueError(f"the libraries differ on {run}: {own!r} and {other!r}")
        return found

    def _signs(self, run: tuple[int, ...]) -> list[tuple[int, ...]]:
        """A run of byte pieces cut into signs; a byte that belongs to none stands alone, as the libraries differ on longer runs with such bytes."""
        raw, at, out = bytes(int(self.pieces[i][3:-1], 16) for i in run), 0, []
        while at < len(raw):
            size = 1 if raw[at] < 0xC0 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            try:
                raw[at : at + size].decode()
            except UnicodeDecodeError:
                size = 1
            out.append(run[at : at + size])
            at += size
        return out

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
        """The texts of ids; ``begin`` has the first place of each text in ``ids``, and the end."""
        spoken = ~self.silent[ids]
        ids, begin = ids[spoken], np.concatenate(([0], np.cumsum(spoken)))[begin]
        given = ids.tolist()
        parts, length = list(map(self.surface.__getitem__, given)), self.length[ids]
        if (byte := self.is_byte[ids]).any():
            border = np.zeros(len(ids), bool)
            border[begin[:-1][begin[:-1] < len(ids)]] = True
            first = np.flatnonzero(byte & (border | ~np.concatenate(([False], byte[:-1]))))
            last = np.flatnonzero(byte & np.concatenate(((border | ~byte)[1:], [True]))) + 1
            runs = [tuple(given[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            signs = {run: self._signs(run) for run in dict.fromkeys(runs)}
            distinct = list(dict.fromkeys(x for found in signs.values() for x in found))
            spelt = dict(zip(distinct, [x.encode() for x in self.spell(list(map(list, distinct)))], strict=True))
            known = {run: b"".join(map(spelt.__getitem__, found)) for run, found in signs.items()}
            length[byte] = 0
            for a, b, run in zip(first.tolist(), last.tolist(), runs, strict=True):
                parts[a:b] = [known[run]] + [b""] * (b - a - 1)
                length[a] = len(known[run])
        ends = np.concatenate(([0], np.cumsum(length)))
        raw, starts, stops = b"".join(parts), ends[begin[:-1]], ends[begin[1:]]
        if self.prefix:  # the blank that marks a text's start is no part of it
            there = begin[:-1] < begin[1:]
            starts[there] += self.marked[ids[begin[:-1][there]]]
        return pa.array([raw[a:b].decode() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.string())


_backends: dict[tuple, Backend] = {}


def backend(path: str, threads: int = THREADS, verify: bool = True) -> Backend:
    key = (path, threads, verify)
    if key not in _backends:
        _backends.clear()
        _backends[key] = Backend(*key)
    return _backends[key]


def _with(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in columns.items())])


def _list(found: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(found.astype(np.int32)))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", verify: bool = True, threads: int = THREADS) -> DataFrame:
    """``docs`` with the ids of each text."""
    path, docs = path or model_path(), docs.drop(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = backend(path, threads, verify)
        for batch in batches:
            for part in words.slices(batch, text):
                column = _list(*own.encode(words.texts(part, text)))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, ids])

    return docs.mapInArrow(words.returning(work), _with(docs, **{ids: T.ArrayType(T.IntegerType())}))


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded", verify: bool = True, threads: int = THREADS) -> DataFrame:
    """``encoded`` with the text of its ids."""
    path, encoded = path or model_path(), encoded.drop(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = backend(path, threads, verify)
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch[ids]), 0).to_numpy(zero_copy_only=False)
            begin = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
            found = own.decode(pc.list_flatten(batch[ids]).to_numpy(zero_copy_only=False), begin)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, text])

    return encoded.mapInArrow(words.returning(work), _with(encoded, **{text: T.StringType()}))


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str = "decoded", verify: bool = True, threads: int = THREADS) -> DataFrame:
    """``docs`` with the ids of each text and the text of these ids, in one pass with one model a worker."""
    path, docs = path or model_path(), docs.drop(ids, decoded)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = backend(path, threads, verify)
        for batch in batches:
            for part in words.slices(batch, text):
                found, begin = own.encode(words.texts(part, text))
                yield pa.RecordBatch.from_arrays([*part.columns, _list(found, begin), own.decode(found, begin)], names=[*part.schema.names, ids, decoded])

    return docs.mapInArrow(words.returning(work), _with(docs, **{ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}))
