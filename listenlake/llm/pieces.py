"""SentencePiece BPE encoding and decoding by vectorised merge rounds, with the results of the library.

A text is normalised as the model says (identity, a dummy space in front, spaces as U+2581) and cut where no piece can
lie: before a run of U+2581. Words repeat; a worker keeps what it knows of those it has met (at most KEPT). New words are
merged together by bpe.Merges: a pair's rank is the score of the piece that it makes, ties go to the leftmost. Characters
without a piece become the ids of their UTF-8 bytes. Null texts count as empty; an empty text has the end id only.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from listenlake.llm.common import texts as id_and_text
from listenlake.llm.word_tokens import in_groups

KEPT = 300_000
SPACE_MARK = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTokenizer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        from listenlake.llm.bpe import Merges

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces:
            raise ValueError("only BPE models without text normalisation")
        if not (proto.trainer_spec.byte_fallback and spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("only models with byte fallback, a dummy prefix and escaped spaces")
        kinds = model.ModelProto.SentencePiece
        self.end = proto.trainer_spec.eos_id
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in normal):
            raise ValueError("a piece holds a space after a letter")
        self.size = len(proto.pieces)
        self.bytes = np.zeros(256, np.int32)
        self.surface: list[bytes] = []  # a piece's part of the decoded text
        for i, p in enumerate(proto.pieces):
            surface = p.piece.replace(SPACE_MARK, " ").encode()
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes[value] = i
                surface = bytes([value])
            elif p.type == kinds.CONTROL:
                surface = b""
            elif p.type == kinds.UNKNOWN:
                surface = proto.trainer_spec.unk_surface.encode()
            self.surface.append(surface)
        self.number = [str(i) for i in range(self.size)]
        # Symbols: ids of pieces; a character without a piece is its code point plus size.
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({proto.pieces[i].score for i in normal.values()}, reverse=True))}
        rows = []

        def known(part: str) -> int | None:
            return int(self.symbol[ord(part)]) if len(part) == 1 else normal.get(part)

        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = known(p[:cut]), known(p[cut:])
                if a is not None and b is not None:
                    rows.append((a, b, order[proto.pieces[i].score], i))
        pairs = np.array(rows, np.int64).reshape(-1, 4)
        self.merges = Merges(pairs[:, 0], pairs[:, 1], pairs[:, 2], pairs[:, 3], self.size + 0x110000)
        self.words = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+").findall
        #: word -> (its ids in decimal, joined; how many; its part of the decoded text)
        self.known: dict[str, tuple[str, int, str]] = {}

    def cut(self, text: str) -> list[str]:
        """Words of the normalised text."""
        if not text:
            return []
        if "  " in text or SPACE_MARK in text or text[0] == " ":
            return self.words(SPACE_MARK + text.replace(" ", SPACE_MARK))
        # A line end is no part of a longer piece, so it may begin a word.
        return (SPACE_MARK + text.replace(" ", " " + SPACE_MARK).replace("\n", " \n")).split(" ")

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        raw = [w.encode("utf-32-le") for w in words]
        size = np.array([len(r) // 4 for r in raw], np.int64)
        made, length = self.merges.merge(self.symbol[np.frombuffer(b"".join(raw), "<u4")], size)
        flat, ends = made.tolist(), np.cumsum(length).tolist()
        odd = np.zeros(len(words), bool)
        odd[np.repeat(np.arange(len(words)), length)[made >= self.size]] = True
        out = [flat[b - n : b] for b, n in zip(ends, length.tolist())]
        for i in np.flatnonzero(odd).tolist():
            ids: list[int] = []
            for s in out[i]:
                ids += [s] if s < self.size else self.bytes[list(chr(s - self.size).encode())].tolist()
            out[i] = ids
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes joined, without the dummy space in front."""
        out = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out

    def encode(self, text: str) -> list[int]:
        """Ids of one text, with the end id."""
        return [i for w in self.merge(self.cut(text)) for i in w] + [self.end] if text else [self.end]

    def learn(self, new: list[str]) -> None:
        number, surface = self.number, self.surface
        for w, ids in zip(new, self.merge(new)):
            back = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
            self.known[w] = (" ".join([number[i] for i in ids]), len(ids), back)

    def texts(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """For each text: how many ids, the ids in decimal joined by a space, the text decoded from them."""
        words = [self.cut(t) for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        new = set()
        for w in words:
            new.update(w)
        new.difference_update(self.known)
        if new:
            self.learn(list(new))
        counts, numbers, decoded = [], [], []
        end = self.number[self.end]
        for w in words:
            entries = [self.known[x] for x in w]
            counts.append(sum([e[1] for e in entries]) + 1)
            numbers.append(" ".join([e[0] for e in entries] + [end]))
            out = "".join([e[2] for e in entries])
            decoded.append(out[1:] if out[:1] == " " else out)
        return counts, numbers, decoded


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PieceTokenizer:
    """One for each worker."""
    return PieceTokenizer(path)


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def _per_text(docs: DataFrame, schema: str, make) -> DataFrame:
    """A row for each document; make(texts) gives the columns beside doc_id, a batch of bounded size at a time."""
    rows = id_and_text(docs)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}"

    def over(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1).to_pylist()
            for at, group in in_groups(column):
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(group)), *make(group)], names=names)

    names = ["doc_id", *[part.split()[0] for part in schema.split(", ")[1:]]]
    return rows.mapInArrow(over, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids (array<int>) of each whole text, the end id last."""
    path = path or default_path()

    def make(group):
        tok = tokenizer(path)
        _, numbers, _ = tok.texts(group)
        return [pa.array([np.array(n.split(" "), np.int32) for n in numbers], pa.list_(pa.int32()))]

    return _per_text(docs, "ids array<int>", make)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give a null text."""
    path = path or default_path()
    rows = encoded.select("doc_id", "ids")

    def over(batches):
        for batch in batches:
            tok = tokenizer(path)
            out = [None if ids is None else tok.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(over, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids in decimal, SHA-256 of the text decoded from them."""
    path = path or default_path()

    def make(group):
        counts, numbers, decoded = tokenizer(path).texts(group)
        return [pa.array(counts, pa.int64()), pa.array(map(_sha, numbers), pa.string()), pa.array(map(_sha, decoded), pa.string())]

    return _per_text(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
