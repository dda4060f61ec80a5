"""Byte-level BPE encoding and decoding over a trie of distinct words.

Method. BPE encodes every prefix of a word consistently: the encoding of the
prefix ending at byte ``i`` is the encoding of some shorter prefix followed by
one *last token*, and that token is the only vocabulary suffix whose pair with
the shorter prefix's own last token survives merging. So one integer per trie
node (its last token) determines the node's whole encoding. The distinct words
of a slice are visited in sorted order, which is a depth-first walk of their
trie: the states of the prefix shared with the preceding word stay on the
stack and are computed once.

Defined edge cases: a null or empty text has no tokens and decodes to an empty
string; repeated rows give repeated results; no text is cut.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, held, slices, texts_of

# Code points that Unicode assigned letters or numbers after version 16, the one the public
# tokenizer library knows. The regex module is newer; here they are neither.
NEWER = (
    r"\U00000558\U0000058b-\U0000058c\U0000088f\U00000c5c\U00000cdc\U0000208f\U0000209d-\U0000209f\U0000a7ce-\U0000a7cf"
    r"\U0000a7d2\U0000a7d4\U0000a7dd\U0000a7e2\U0000a7f1\U0000ab6c-\U0000ab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    r"\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    r"\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    r"\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)

# Fixed value: the published pre-tokenisation pattern of this vocabulary, with L and N as of Unicode 16.
L, N = rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]"
WORD_PATTERN = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"

# The same pattern for texts of code points below 256, where the classes are short; letters first, as
# nothing else starts like them.
_L, _N, _S = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼-¾", r"\t-\r\x20\x85\xa0"
LATIN_PATTERN = rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"

#: Words in one generation of a Python worker's memory. When it is full, it becomes the older one and the words
#: met again move on from there; so frequent words stay and there are never more than two generations.
MEMO_WORDS = 300_000
#: Bytes of text that are split into words at once, of which each takes some sixty bytes.
SLICE = 1 << 20
#: Longer words are encoded but not remembered.
MEMO_WORD_BYTES = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of every byte: itself if visible, else the next code point from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieBpe:
    """Encoder and decoder for a byte-level BPE vocabulary in the tokenizers JSON format."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        alphabet = byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(alphabet[c] for c in token)

        vocab = data["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: raw(t) for t, i in vocab.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[int, int] = {}  # pair key -> merge order
        self.born: dict[int, int] = {}  # token -> merge order that makes it
        self.halves: dict[int, tuple[int, int]] = {}
        for order, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left << 20 | right] = order
            if whole not in self.born:
                self.born[whole] = order
                self.halves[whole] = (left, right)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", ())}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(WORD_PATTERN)
        self.latin_words = re.compile(LATIN_PATTERN)
        # Reversed-token trie: from a node's last byte backwards, every vocabulary suffix is on one path.
        self.back: list[dict[int, int]] = [{}]
        self.back_token: list[int] = [-1]
        for token, i in self.id_of.items():
            at = 0
            for byte in reversed(token):
                step = self.back[at].get(byte)
                if step is None:
                    step = self.back[at][byte] = len(self.back)
                    self.back.append({})
                    self.back_token.append(-1)
                at = step
            self.back_token[at] = i
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merge(self, a: int, b: int) -> bool:
        """Do two adjacent tokens stay apart when their joint bytes are merged from single bytes?

        Near the boundary only the right spine of ``a`` and the left spine of
        ``b`` can meet. Both spines are undone from the last merge backwards;
        at each state the boundary pair must not have an earlier merge than
        the one that consumes it.
        """
        never = 1 << 40
        until = never
        while True:
            order = self.rank.get(a << 20 | b, never)
            if order < until:
                return False
            born_a, born_b = self.born.get(a, -1), self.born.get(b, -1)
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b:
                until, a = born_a, self.halves[a][1]  # a's right part waited until then
            else:
                # Of equal merges the left one is done first, so b's part may still be taken at that order.
                until, b = born_b + 1, self.halves[b][0]

    def encode_words(self, words: Iterable[str]) -> None:
        """Put the encodings of distinct words in the memo, visiting their trie depth-first."""
        back, back_token, fits, memo = self.back, self.back_token, self.fits, self.memo
        path = b""
        last: list[int] = []  # last token of each prefix on the current trie path
        size: list[int] = []  # and its length in bytes
        for word, raw in sorted(((w, w.encode()) for w in words), key=lambda x: x[1]):
            n, shared = len(raw), 0
            most = min(n, len(path))
            while shared < most and raw[shared] == path[shared]:
                shared += 1
            del last[shared:], size[shared:]
            for end in range(shared, n):
                found: list[tuple[int, int]] = []
                at, i = 0, end
                while i >= 0:
                    step = back[at].get(raw[i])
                    if step is None:
                        break
                    at = step
                    if back_token[at] >= 0:
                        found.append((back_token[at], end - i + 1))
                    i -= 1
                for token, length in reversed(found):
                    if length > end:  # the whole prefix is one token
                        break
                    key = last[end - length] << 20 | token
                    ok = fits.get(key)
                    if ok is None:
                        if len(fits) > 2_000_000:
                            fits.clear()
                        ok = fits[key] = self._merge(key >> 20, token)
                    if ok:
                        break
                last.append(token)
                size.append(length)
            path = raw
            ids: list[int] = []
            at = n
            while at:
                ids.append(last[at - 1])
                at -= size[at - 1]
            ids.reverse()
            memo[word] = array("I", ids).tobytes()

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words.findall(text)
        return self.latin_words.findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        split: list[list[str]] = []
        for text in texts:
            if self.specials is not None and any(s in text for s in self.special):
                pieces: list[str] = []
                for part in self.specials.split(text):
                    pieces += [part] if part in self.special else self.split(part)
                split.append(pieces)
            else:
                split.append(self.split(text))
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            self.older, self.memo = memo, {}
            memo = self.memo
        for text, i in self.special.items():
            memo[text] = np.array([i], dtype="<u4").tobytes()
        new = set().union(*split).difference(memo) if split else set()
        older = self.older
        known = new.intersection(older)
        for word in known:
            memo[word] = older[word]
        new -= known
        self.encode_words(new)
        out = [b"".join(map(memo.__getitem__, pieces)) for pieces in split]
        for word in new:
            if len(word) > MEMO_WORD_BYTES:
                del memo[word]
        return out

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def _tokenizer(spec: str) -> TrieBpe:
    return held("bpe", hash(spec), lambda: TrieBpe(spec))


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode the whole text of every row.

    Returns ``id_col``, ``n_tokens`` (long), ``token_ids`` (binary, ids as
    little-endian unsigned 32-bit integers) and ``decoded`` (string). One
    narrow map over the input: no shuffle, no state between rows. The
    vocabulary file is read on the driver and broadcast; its size is checked.
    """
    with open(vocab_path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > BROADCAST_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        bpe = _tokenizer(shared.value)
        for part in slices(batches, 1, SLICE):
            ids = bpe.encode_batch(texts_of(part, 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                names=[id_col, "n_tokens", "token_ids", "decoded"],
            )

    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        "n_tokens",
        F.sha2(F.col("token_ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
