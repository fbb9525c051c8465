"""Token ids of a byte-level BPE file (the tokenizers library's JSON), word by word.

Offline, on the driver, the file is searched for facts that hold for every text:
* its pre-tokens (the byte-level pattern) never join a character that is not white space to a space that follows, so a
  text may be cut before each such space, and equal words have equal ids wherever they stand;
* every entry of the vocabulary encodes alone to itself, each has one merge, and ids are in the order of merges. Then
  merging by the rank of what two neighbours make together is merging by the list: before a rank is reached, the bytes of
  an entry are in the state they reach alone, which is the listed pair. So an encoder by ranks gives the same ids.
On the workers each distinct word is encoded once and remembered in a table of bounded size. Texts with an added token's
string and files without these facts go to the library whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterable

#: words with later characters are left to the library, as tables of character classes differ in age
KNOWN_CLASSES = "ɐ"
#: a text with none of these may be cut before every space
RUNS = re.compile(r" (?<=\s )(?:\s|$)").search
BREAKS = re.compile(r"(?<=\S)(?= )").split
MEMO_LENGTH = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte in the file: printable ones for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


def token_bytes(tokenizer) -> dict[bytes, int]:
    """Bytes of each token that stands for bytes; added tokens stand for their strings."""
    value = {c: b for b, c in enumerate(byte_characters())}
    return {bytes(map(value.__getitem__, s)): i for s, i in tokenizer.get_vocab(with_added_tokens=False).items()}


def file_facts(model: str) -> dict:
    """{ranks, added}: bytes to ids, and the added tokens' strings; without ranks where the facts don't hold."""
    from tokenizers import Tokenizer

    told, tokenizer = json.loads(model), Tokenizer.from_str(model)
    added = [t["content"] for t in told.get("added_tokens", [])]
    pre, bpe = told.get("pre_tokenizer") or {}, told["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told.get("added_tokens", []))
    if not plain or bpe.get("type") != "BPE" or any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) or any(" " in s for s in added):
        return {"added": added}
    vocab = {s: i for s, i in bpe["vocab"].items() if s not in added}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in bpe["merges"]]
    single = sorted(set(vocab) - set(made), key=vocab.get)
    in_order = set(single) == set(byte_characters()) and len(made) == len(set(made)) and [vocab.get(s) for s in made] == list(range(256, 256 + len(made))) and sorted(vocab[s] for s in single) == list(range(256))
    if not in_order or any([t.id for t in tokenizer.model.tokenize(s)] != [i] for s, i in vocab.items()):
        return {"added": added}
    value = {c: b for b, c in enumerate(byte_characters())}
    return {"added": added, "ranks": {bytes(map(value.__getitem__, s)): i for s, i in vocab.items()}}


def packed(ids: Iterable[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Words(dict):
    """Packed 32-bit ids of a space and the word, encoded when first met. A full table becomes the old one, and a new one takes
    from it what is met again, so frequent words stay."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word) or self.encode(f" {word}")
        if len(word) <= MEMO_LENGTH:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def words_of(text: str) -> list[str]:
    """The text after a space, cut before each space that follows another character, without the cuts' spaces."""
    return [s[1:] for s in BREAKS(f" {text}")] if text[:1] == " " or "  " in text or RUNS(text) else text.split(" ")


class Encoder:
    """encode(text): packed little-endian 32-bit ids, as the library gives them without special tokens around."""

    def __init__(self, model: str, facts: dict, added_as_text: bool = False, most: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.library.encode_special_tokens = added_as_text
        self.added = [] if added_as_text else facts["added"]
        self.whole = "ranks" not in facts
        if not self.whole:
            import public_tokenizers
            import tiktoken

            self.by_rank = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=facts["ranks"], special_tokens={}).encode_ordinary
        self.words = Words(self.some, most)

    def by_library(self, text: str) -> bytes:
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def some(self, piece: str) -> bytes:
        return packed(self.by_rank(piece)) if max(piece) < KNOWN_CLASSES else self.by_library(piece)

    def after_space(self, text: str) -> bytes:
        """Ids of a space and the text."""
        if self.whole or any(s in text for s in self.added):
            return self.by_library(f" {text}")
        return b"".join(map(self.words.__getitem__, words_of(text)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.whole or any(s in text for s in self.added):
            return self.by_library(text)
        if text[0] == " ":
            return self.after_space(text[1:])
        first, space, rest = text.partition(" ")
        if not space:
            return self.some(first)
        if first[-1].isspace():  # its white space and what follows are one run
            first, *more = BREAKS(text)
            return self.some(first) + b"".join(self.words[s[1:]] for s in more)
        return self.some(first) + self.after_space(rest)
