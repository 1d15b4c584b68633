"""SentencePiece BPE by a table of last tokens.

For byte pair encoding each prefix of a text has one token that its encoding ends with: among the pieces that match up to
that place (an automaton finds them), it is the one that is compatible with the last token of the prefix before it, that is,
the pair alone is encoded as the pair. The table holds this token's length for each prefix; following it from the end
recovers the ids backwards.

No piece has a blank after another character, so a text falls apart before each run of blanks: pieces never cross such a place
and what is merged on one side doesn't depend on the other. Segments repeat, so each task keeps a bounded store of them.
Characters without a piece become their UTF-8 bytes' ids.

The model file is read on the driver and goes to the tasks whole; its size is checked against MODEL_BYTES. Its normaliser must
be the identity, with a dummy blank first, blanks kept, and byte fallback; other models are refused.

Defined cases: null counts as the empty text, which has only the begin and end ids; texts of any length are encoded whole;
null ids, repeated rows and other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL_BYTES = 32 << 20
#: Segments in each of a task's two stores, the length in characters up to which it keeps them, and pairs that it keeps.
STORE, STORED_CHARS, PAIRS = 120_000, 32, 200_000
BLANK = "▁"
NO_BYTE = b"\xff".decode("utf-8", "surrogateescape")


class PrefixTableBPE:
    def __init__(self, model: bytes) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        kinds = proto.SentencePiece
        plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if spec.model_type != spec.BPE or not spec.byte_fallback or not plain or spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with an identity normaliser, a dummy blank first and byte fallback are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.bos, self.eos = spec.bos_id, spec.eos_id
        self.pieces = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.control = {k for k, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.of_byte = {k: b for b, k in self.byte.items()}
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("pieces with a blank after another character are not supported")
        #: Order in which pieces are merged, characters before all; and the two parts of each piece's last merge. Pieces that
        #: their own text isn't encoded as can't occur and are left out.
        self.rank = {p: k for k, p in enumerate(sorted(self.score, key=self.score.get, reverse=True)) if len(p) > 1}
        self.parts: dict[str, tuple[str, str]] = {}
        for p in self.rank:
            got, parts = self.merges(p)
            if got == [p]:
                self.parts[p] = parts
        self.automaton = ahocorasick.Automaton()
        for p in self.parts:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.store: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # a byte id stands for its byte until all bytes of the text are there; a control id inside a text for a byte that none has
        self.text_of = [p.replace(BLANK, " ") for p in self.pieces]
        for k in self.control:
            self.text_of[k] = NO_BYTE
        for k, b in self.of_byte.items():
            self.text_of[k] = bytes([b]).decode("utf-8", "surrogateescape")
        self.text_of[spec.unk_id] = spec.unk_surface

    def merges(self, s: str) -> tuple[list[str], tuple[str, str]]:
        """The definition: of all neighbours that make a piece, those of the best score are merged, leftmost first. Returns the
        tokens and the two that were merged last."""
        part, left, right = list(s), [*range(-1, len(s) - 1)], [*range(1, len(s) + 1)]
        heap: list[tuple[float, int, str]] = []
        newest = ("", "")

        def offer(i: int) -> None:
            if i >= 0 and right[i] < len(part) and (p := part[i] + part[right[i]]) in self.score:
                heapq.heappush(heap, (-self.score[p], i, p))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, p = heapq.heappop(heap)
            if part[i] is None or right[i] >= len(part) or part[i] + part[right[i]] != p:
                continue
            j = right[i]
            newest = part[i], part[j]
            part[i], part[j], right[i] = p, None, right[j]
            if right[i] < len(part):
                left[right[i]] = i
            offer(i)
            offer(left[i])
        return [p for p in part if p is not None], newest

    def compatible(self, a: str, b: str) -> bool:
        """Whether the text a + b is encoded as a, b: no piece across the border is merged before the parts beside it are gone.

        Both tokens are taken apart from the later merge to the earlier, which gives all states of the border in turn.
        """
        if a[-1] == BLANK:  # runs of blanks have pieces of equal score, for which only the definition tells the order
            return self.merges(a + b)[0] == [a, b]
        rank, parts = self.rank, self.parts
        limit = len(rank) + 1
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, parts[a][1]
            else:
                limit, b = rb + 1, parts[b][0]

    def tokens(self, s: str) -> list[str]:
        """Tokens of a segment: the last token of each prefix, then backwards from the end."""
        last: list[str | None] = [None] * (len(s) + 1)
        pairs, nxt = self.pairs, 1  # nxt: length of the least prefix without a last token
        for end, p in self.automaton.iter(s):  # at each place the longest match first
            i = end + 1
            while nxt < i:  # nothing longer fitted
                last[nxt] = s[nxt - 1]
                nxt += 1
            if nxt > i:
                continue
            before = last[i - len(p)]
            if before is None:
                fits = True
            else:
                fits = pairs.get((before, p))
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[before, p] = self.compatible(before, p)
            if fits:
                last[i] = p
                nxt += 1
        while nxt <= len(s):
            last[nxt] = s[nxt - 1]
            nxt += 1
        out, i = [], len(s)
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def packed(self, s: str) -> bytes:
        """Ids of a segment as little-endian 32-bit numbers."""
        ids: list[int] = []
        for p in self.tokens(s):
            k = self.id.get(p)
            if k is None:
                ids += [self.byte[b] for b in p.encode()]
            else:
                ids.append(k)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Packed ids with begin and end."""
        store, older, parts = self.store, self.older, [array("I", [self.bos]).tobytes()]
        for s in _SEGMENT.findall(BLANK + text.replace(" ", BLANK)) if text else ():
            got = store.get(s)
            if got is None:
                got = older.get(s)
                if got is None:
                    got = self.packed(s)
                if len(s) <= STORED_CHARS:
                    if len(store) >= STORE:  # what wasn't used since the last change goes
                        self.store, self.older = {}, store
                        store, older = self.store, self.older
                    store[s] = got
            parts.append(got)
        parts.append(array("I", [self.eos]).tobytes())
        return b"".join(parts)

    def decode(self, packed: bytes) -> str:
        """As the library decodes: control ids vanish, byte ids make characters, the first blank is dropped."""
        ids = array("I", packed)
        while ids and ids[0] in self.control:
            del ids[0]
        while ids and ids[-1] in self.control:
            del ids[-1]
        text_of = self.text_of
        raw = "".join([text_of[k] for k in ids]).encode("utf-8", "surrogateescape")
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = "".join(self._run(kind, run) for kind, run in groupby(ids, self._kind))
        first = next((k for k in ids if k not in self.control), None)
        return text[1:] if first is not None and first not in self.of_byte and self.pieces[first][:1] == BLANK else text

    def _kind(self, k: int) -> int:
        return 2 if k in self.control else k in self.of_byte

    def _run(self, kind: int, run: Iterator[int]) -> str:
        if kind == 2:
            return ""
        return _bytes_text(bytes(self.of_byte[k] for k in run)) if kind else "".join(self.text_of[k] for k in run)


#: A run of blanks and what follows it.
_SEGMENT = re.compile(f"{BLANK}+[^{BLANK}]*")


def _bytes_text(raw: bytes) -> str:
    """Bytes to characters; each byte that starts no valid character becomes one replacement character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_LOADED: dict[bytes, PrefixTableBPE] = {}


def loaded(model: bytes) -> PrefixTableBPE:
    """One table per Python process, whose store serves all tasks that run there."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = PrefixTableBPE(model)
    return _LOADED[model]


def model_bytes(path: str) -> bytes:
    size = Path(path).stat().st_size
    if size > MODEL_BYTES:
        raise ValueError(f"the model has {size} bytes; at most {MODEL_BYTES} are sent to the tasks")
    return Path(path).read_bytes()


def encode_column(text: Column, path: str) -> Column:
    """Struct of n_tokens, ids (packed, little-endian 32 bit) and decoded text."""
    model = model_bytes(path)

    @F.arrow_udf("struct<n_tokens:bigint,ids:binary,decoded:string>")
    def encoded(batch: pa.Array) -> pa.Array:
        bpe = loaded(model)
        ids = [bpe.encode(t or "") for t in batch.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=["n_tokens", "ids", "decoded"])

    return encoded.asNondeterministic()(text)


def encode(docs: DataFrame, path: str, column: str = "pieces", text: str = "text") -> DataFrame:
    """``docs`` with a struct of n_tokens, ids and decoded."""
    return docs.withColumn(column, encode_column(F.col(text), path))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row. Each text is hashed as soon as it is encoded, so that a batch holds no
    ids."""
    model = model_bytes(path)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def hashed(batch: pa.Array) -> pa.Array:
        bpe = loaded(model)
        count, ids, decoded = [], [], []
        for t in batch:
            packed = bpe.encode(t.as_py() or "")
            count.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(packed).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select("doc_id", hashed.asNondeterministic()(F.col("text")).alias("h"))
    return out.select("doc_id", "h.n_tokens", "h.ids_sha256", "h.decoded_sha256")
