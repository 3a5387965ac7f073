"""SentencePiece encoding and decoding of merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose concatenation is a piece,
ordered by score (ties: leftmost first), and merges the best until none is left;
symbols that are no piece fall back to their UTF-8 bytes. A merge can only join
two characters that some piece holds side by side, so a text is first cut where
no piece does, and the agenda of each distinct segment is worked off once and
kept (a table per Python worker, of bounded bytes; long segments are only kept for the texts at hand). Each Arrow batch's new segments are
checked against the sentencepiece library, both ways.

Supported: vocabularies with identity normalisation, white space as U+2581, a
dummy prefix and byte fallback; anything else is refused at load. The vocabulary
file's path is a parameter; the file must be readable on the executors.

Defined results: a null text is the empty text (begin and end ids only); repeated
rows are encoded each; very long texts, and long segments without a space, are encoded whole;
empty tables give empty results; other columns are not looked at. One pass over the input, no shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.texts import map_texts

SPACE = "▁"
#: Segments up to this length keep their agenda as a list, longer ones as a heap.
SHORT = 48
#: Segments over this length are not kept: they hardly come again.
LONG = 512
#: Bytes of a kept segment beside those of its text and ids: two string headers and a table's entry.
ENTRY = 200
NEVER = float("-inf")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """A merge-type vocabulary with its segment table."""

    def __init__(self, path: str, checked: bool = True, most_bytes: int = 48 << 20):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.checked, self.most = checked, most_bytes
        n = sp.get_piece_size()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.surface: list[bytes] = [b""] * n
        self.byte: dict[int, int] = {}
        joined: set[str] = set()
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte[value] = i
                self.surface[i] = bytes([value])
            elif sp.is_unknown(i):
                self.surface[i] = b" \xe2\x81\x87 "
            elif not sp.is_control(i) and not sp.is_unused(i):
                self.id[piece], self.score[piece] = i, sp.get_score(i)
                self.surface[i] = piece.replace(SPACE, " ").encode()
                joined.update(piece[k : k + 2] for k in range(len(piece) - 1))
        self.begin, self.end = (array("I", [i]).tobytes() for i in (sp.bos_id(), sp.eos_id()))
        if any(x[1] == SPACE and x[0] != SPACE for x in joined):
            raise ValueError("pieces that go on after a space are not supported")
        if len(self.byte) != 256 or sp.encode("ﬁ  x")[:1] != [self.id[SPACE]]:
            raise ValueError("only identity normalisation, dummy prefix and byte fallback are supported")
        #: Cuts before each run of spaces, and around line feeds, which no piece holds.
        self.cut = re.compile(r"\n| +[^ \n]*|[^ \n]+").findall
        if any("\n" in p for p in self.id):
            self.cut = re.compile(r" +[^ ]*|[^ ]+").findall
        #: Packed ids by segment; and the bytes of those that don't decode to themselves.
        self.table: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        #: Bytes of the kept segments, and the long ones of the texts at hand.
        self.size = 0
        self.passing: list[str] = []

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment (with plain spaces), by the agenda."""
        score = self.score
        sym: list[str | None] = list(segment.replace(" ", SPACE))
        n = len(sym)
        if n == 1:
            return self._ids(sym)
        if n <= SHORT:
            # The agenda of a short segment: the pairs' scores in place; the first of the best is next.
            get = score.get
            agenda = [get(a + b, NEVER) for a, b in zip(sym, sym[1:])]
            while agenda and (best := max(agenda)) != NEVER:
                i = agenda.index(best)
                sym[i] += sym.pop(i + 1)
                del agenda[i]
                if i:
                    agenda[i - 1] = get(sym[i - 1] + sym[i], NEVER)
                if i < len(agenda):
                    agenda[i] = get(sym[i] + sym[i + 1], NEVER)
            return self._ids(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(-s, i, sym[i] + sym[i + 1]) for i in range(n - 1) if (s := score.get(sym[i] + sym[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            if sym[i] is None or (j := right[i]) < 0 or len(sym[i]) + len(sym[j]) != len(piece) or sym[i] + sym[j] != piece:
                continue
            sym[i], sym[j] = piece, None
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (s := score.get(piece + sym[k])) is not None:
                    heapq.heappush(agenda, (-s, i, piece + sym[k]))
            if (k := left[i]) >= 0 and (s := score.get(sym[k] + piece)) is not None:
                heapq.heappush(agenda, (-s, k, sym[k] + piece))
        return self._ids([s for s in sym if s is not None])

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if (i := self.id.get(s)) is not None:
                out.append(i)
            else:
                out.extend(self.byte[b] for b in s.encode())
        return out

    def segments(self, text: str) -> list[str]:
        return self.cut(" " + text.replace(SPACE, " ")) if text else []

    def _bytes(self, segment: str) -> int:
        """Of a kept segment, at most: its characters, its ids and, where it is odd, its surface."""
        return 8 * len(segment) + len(self.table[segment]) + ENTRY

    def learn(self, needed: set[str]) -> None:
        """Have all these segments in the table, new ones checked against the library."""
        for s in self.passing:
            del self.table[s]
            self.odd.pop(s, None)
        self.passing = []
        new = list(needed.difference(self.table))
        if new and self.size > self.most:
            # What the texts at hand use stays: mostly the frequent segments.
            self.table = {s: self.table[s] for s in needed.intersection(self.table)}
            self.odd = {s: self.odd[s] for s in needed.intersection(self.odd)}
            self.size = sum(self._bytes(s) for s in self.table)
        for s in new:
            ids = self.merge(s)
            self.table[s] = array("I", ids).tobytes()
            if len(s) > LONG:
                self.passing.append(s)
            else:
                self.size += self._bytes(s)
            surface = b"".join([self.surface[i] for i in ids])
            if surface != s.encode():
                self.odd[s] = surface
        if self.checked and (whole := [s for s in new if s[0] == " " and s.strip(" ")]):
            # Segments that hold more than spaces are independent, so one text of them all checks the batch.
            text = "".join(whole)[1:]
            ids = self.library.encode(text)
            if array("I", ids).tobytes() != b"".join([self.table[s] for s in whole]):
                raise AssertionError("the library encodes otherwise: " + text[:200])
            if self.decode(ids) != self.library.decode(ids):
                raise AssertionError("the library decodes otherwise: " + text[:200])

    def encode_packed(self, text: str, seg: list[str] | None = None) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit integers with begin and end, decoded UTF-8)."""
        if seg is None:
            seg = self.segments(text)
            self.learn(set(seg))
        ids = b"".join([self.begin, *map(self.table.__getitem__, seg), self.end])
        if not self.odd or self.odd.keys().isdisjoint(seg):  # every segment decodes to itself
            return ids, text.replace(SPACE, " ").encode()
        raw = b"".join([self.odd.get(s) or s.encode() for s in seg])
        return ids, raw[1:].decode(errors="replace").encode()

    def encode(self, text: str | None) -> list[int]:
        packed, _ = self.encode_packed(text or "")
        return [int.from_bytes(packed[k : k + 4], "little") for k in range(0, len(packed), 4)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control ids give nothing, the dummy prefix is dropped."""
        raw = b"".join(self.surface[i] for i in ids)
        first = next((i for i in ids if self.surface[i]), None)
        if first is not None and self.surface[first][:1] == b" " and self.library.id_to_piece(first)[:1] == SPACE:
            raw = raw[1:]
        return raw.decode(errors="replace")


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per Python worker; its table serves all tasks of that worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of each text's ids, and digest of the text decoded from them."""

    def run(c: dict[str, list]) -> pa.RecordBatch:
        m = model(path)
        texts = [t or "" for t in c["text"]]
        cut = [m.segments(t) for t in texts]
        m.learn(set().union(*cut))
        n, ids, out = [], [], []
        for t, seg in zip(texts, cut):
            a, b = m.encode_packed(t, seg)
            n.append(len(a) // 4)
            ids.append(hashlib.sha256(a).hexdigest())
            out.append(hashlib.sha256(b).hexdigest())
        return pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA, 64)
