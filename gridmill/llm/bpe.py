"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

Let e(i) be the last token of the encoding of the first i bytes of a piece of text.  BPE has two properties that
make e(i) computable left to right: a merge never crosses a boundary that is in the result, so what stands
before a boundary j is the encoding of the first j bytes alone; and a token t may follow a token u
exactly if the encoding of their joined bytes is (u, t).  So e(i) is the one token t ending at i for which
the pair (e(i - len(t)), t) is stable, and it needs only the last ``lookahead`` values of e.

The merge list's sufficient lookahead is the length of its longest token: whatever bytes follow,
the token that covers position i starts in the last ``lookahead`` bytes, hence a token on the paths of all these
positions is final.  The transducer emits such tokens and forgets them, so pending state
stays within a few lookaheads however long a piece is.

Decoding feeds token bytes to an incremental byte-to-text state machine; bytes that are not
UTF-8 become U+FFFD.  Texts pass through both some tens of thousands of characters at a time, cut where a pre-token starts for
certain, so besides the text itself memory doesn't grow with it.  A stretch without such a place is one part; a pre-token in it
still streams.

Defined cases: null counts as empty text, which has no tokens.  The special token's own string in a text is that
token, as in the tokenizers library.  An empty table gives an empty result.  Rows are encoded one by one, so ties, repeated rows and null ids need no care.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sliced, tidied
from ._memo import Memo

#: The byte-level alphabet's printable ranges, and the pre-tokenizer's pattern with white space spelt out.
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if printable, else the next from U+0100."""
    plain = {b for low, high in PRINTABLE for b in range(low, high + 1)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, memo: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda token: bytes(to_byte[c] for c in token)
        self.bytes_of = {i: raw(t) for t, i in spec["model"]["vocab"].items()}
        self.ranks = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[raw(left), raw(right)] = k
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        special = set(self.special.values())
        ids = {b: i for i, b in self.bytes_of.items() if i not in special}
        self.lookahead = max(map(len, ids))
        self.single = {b: i for b, i in ids.items() if self._merged(b) == [b]}
        #: Every suffix of a token, with the token's id if it is one that encoding can give.
        self.suffix = dict.fromkeys((b[k:] for b in ids for k in range(len(b))), -1) | self.single
        self.follows: dict[tuple[int, int], bool] = {}
        self.pretokens = regex.compile(PATTERN).findall
        self.space_run = regex.compile(rf" [{WS}]").search
        self.boundary = regex.compile(rf"(?<=[^{WS}]) (?=[^{WS}])").search
        self.at_special = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        self.pieces, self.memo = Memo(self._piece), Memo(self._unit, memo)

    def _merged(self, data: bytes) -> list[bytes]:
        """The merge rules applied one by one; only for strings of one or two tokens."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, u: int, t: int) -> bool:
        a, b = self.bytes_of[u], self.bytes_of[t]
        found = self._merged(a + b) == [a, b]
        if len(self.follows) >= 1_000_000:
            self.follows.clear()
        self.follows[u, t] = found
        return found

    def _advance(self, data: bytes, last: list[int], before: int) -> None:
        """Extend ``last`` to all of ``data``."""
        suffix, follows = self.suffix.get, self.follows.get
        for i in range(len(last), len(data) + 1):
            found, at = [], i - 1
            while at >= 0 and (t := suffix(data[at:i])) is not None:
                if t >= 0:
                    found.append((t, at))
                at -= 1
            for t, at in reversed(found):
                u = last[at] if at else before
                if u < 0 or (ok := follows((u, t))) or (ok is None and self._may_follow(u, t)):
                    last.append(t)
                    break

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one piece given in chunks, each emitted as soon as it is final."""
        data, last = b"", [-1]  # last[i]: the token that ends at byte i of what is pending
        before = -1  # the token emitted last
        for chunk in chunks:
            for k in range(0, len(chunk), self.lookahead):
                data += chunk[k : k + self.lookahead]
                self._advance(data, last, before)
                if len(data) >= 4 * self.lookahead and (done := self._final(last, self.lookahead)):
                    yield from done
                    size = sum(len(self.bytes_of[t]) for t in done)
                    data, last, before = data[size:], [-1, *last[size + 1 :]], done[-1]
        yield from self._path(last, len(last) - 1)

    def _path(self, last: list[int], i: int) -> list[int]:
        out = []
        while i > 0:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return out[::-1]

    def _final(self, last: list[int], keep: int) -> list[int]:
        """The tokens on the paths of all of the last ``keep`` positions."""
        common = None
        for i in range(len(last) - keep, len(last)):
            path = self._path(last, i)
            if common is None:
                common = path
            else:
                k = next((k for k, (a, b) in enumerate(zip(common, path)) if a != b), min(len(common), len(path)))
                common = common[:k]
        return common or []

    def _piece(self, piece: str) -> bytes:
        """Little-endian 32-bit ids of one pre-token."""
        data = piece.encode()
        whole = self.single.get(data)
        if whole is not None:
            out = [whole]
        elif len(data) <= self.lookahead:  # nothing is final before its end
            last = [-1]
            self._advance(data, last, -1)
            out = self._path(last, len(data))
        else:
            out = list(self.stream(data[k : k + 4096] for k in range(0, len(data), 4096)))
        return struct.pack(f"<{len(out)}I", *out)

    def _unit(self, text: str) -> bytes:
        """Ids of a text that starts where a pre-token may start."""
        return b"".join(map(self.pieces.__getitem__, self.pretokens(text)))

    def _plain(self, text: str) -> bytes:
        get = self.memo.__getitem__
        if self.space_run(text):
            return self._unit(text)
        first, *rest = text.split(" ")
        # A single space before a word always starts a pre-token.
        return b"".join([get(first) if first else b"", *[get(" " + w) for w in rest]])

    def parts(self, text: str, step: int = 1 << 16) -> Iterator[bytes]:
        """Ids of ``text``, some tens of thousands of characters at a time.

        A part ends before a single space between two other characters, where a pre-token always starts and which no special token holds.
        """
        at = 0
        while at < len(text):
            cut = self.boundary(text, at + step)
            end = cut.start() if cut else len(text)
            yield self.encode(text[at:end])
            at = end

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of ``text``."""
        if not self.special or not self.at_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [self._plain(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: Iterable[int], step: int = 4096) -> Iterator[str]:
        """The text of ``ids``, in parts."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get, ids = self.bytes_of.__getitem__, iter(ids)
        while some := b"".join(map(get, islice(ids, step))):
            yield machine.decode(some)
        yield machine.decode(b"", True)


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """One encoder for each worker process and file."""
    return Bpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_values: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded text of every row.

    ``path`` is a vocabulary file that every executor can open.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bpe = loaded(path)
        for batch in sliced(batches):
            out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if with_values else {})
            for text in batch.column(1):
                told, digest, sizes, kept, decoded = hashlib.sha256(), hashlib.sha256(), [], [], []

                def fed(text=text, told=told, sizes=sizes, kept=kept):
                    """The ids one by one, as the encoder emits them."""
                    for part in bpe.parts(text.as_py() or ""):
                        told.update(part)
                        sizes.append(len(part) // 4)
                        if with_values:
                            kept.append(part)
                        yield from np.frombuffer(part, "<u4").tolist()

                for part in bpe.decode(fed()):
                    digest.update(part.encode())
                    if with_values:
                        decoded.append(part)
                out["n_tokens"].append(sum(sizes))
                out["ids_sha256"].append(told.hexdigest())
                out["decoded_sha256"].append(digest.hexdigest())
                if with_values:
                    out["ids"].append(np.frombuffer(b"".join(kept), "<u4").tolist())
                    out["decoded"].append("".join(decoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.values())], names=["_id", *out])

    # An empty batch has no types of its own, so the schema names them.
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_values else "")
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidied(run), schema).withColumnRenamed("_id", id_col)
