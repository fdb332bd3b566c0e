"""Ids of texts chunk by chunk: what lies between ASCII white space is encoded once and kept a while.

For tokenizers that drop white space and lower-case, whose tokens never span white space.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import regex

#: Unicode's White_Space, as the tokenizer's pattern has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+|\n"


# The settings that the code here follows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def check_settings(spec: dict) -> None:
    """Raise unless a tokenizer file normalises and splits texts as the code here does; other files need other code."""
    model = spec["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and t["content"].startswith("<|") for t in spec["added_tokens"])
    if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} or model["type"] != "BPE" or not plain or not added:
        raise ValueError("this tokenizer file splits or normalises texts in another way")


class WordSplitter:
    """The words that such a tokenizer makes of chunks, before it merges letters."""

    def __init__(self, special: Iterable[str]):
        self.special = set(special)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special or ["\n"])) + ")")
        self.words = regex.compile(WORDS)

    def split(self, chunks: list[str]) -> list[str]:
        """The words of all chunks in turn, special tokens whole, and a line feed after each chunk."""
        joined = "\n".join(chunks) + "\n"
        out: list[str] = []
        for piece in self.at_special.split(joined) if "<|" in joined else [joined]:
            if piece in self.special:
                out.append(piece)
            else:
                out += self.words.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
        return out


def rejoin(words: list[str], ids: dict[str, bytes]) -> list[bytes]:
    """The ids of each chunk from those of its words, as WordSplitter lists them."""
    out, held = [], []
    for w in words:
        if w == "\n":
            out.append(b"".join(held))
            held = []
        else:
            held.append(ids[w])
    return out


class ChunkCache:
    """What chunks are encoded to: two generations of about ``most`` bytes, so what was met lately stays.

    Chunks of more than KEEP letters hardly come again; they are let go at the next call.
    """

    KEEP = 64
    #: Bytes that an entry takes besides its key and value.
    ENTRY = 170

    def __init__(self, encode: Callable[[list], list[bytes]], most: int = 48 << 20, block: int = 50_000, split: Callable[[str], list] | None = None):
        self.encode, self.most, self.block = encode, most, block
        self.split = split or self.by_blanks
        self.young: dict = {}
        self.old: dict = {}
        self.held, self.passing = 0, []

    @staticmethod
    def by_blanks(text: str) -> list[bytes]:
        raw = text.encode()
        # A special token is matched before lower-casing, so such a text keeps its case.
        return (raw if b"<|" in raw else raw.lower()).split()

    def look_up(self, wanted: Iterable) -> dict:
        """A mapping that has all of ``wanted``, good until the next call."""
        for c in self.passing:
            del self.young[c]
        self.passing = []
        if self.held > self.most:
            self.young, self.old, self.held = {}, self.young, 0
        young, new = self.young, []
        for c in wanted:
            if c not in young:
                if c in self.old:
                    young[c] = self.old[c]
                    self.held += len(c) + len(young[c]) + self.ENTRY
                else:
                    new.append(c)
        for k in range(0, len(new), self.block):
            for c, v in zip(part := new[k : k + self.block], self.encode(part)):
                young[c] = v
                if len(c) > self.KEEP:
                    self.passing.append(c)
                else:
                    self.held += len(c) + len(v) + self.ENTRY
        return young

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as bytes."""
        chunks = [self.split(t) for t in texts]
        known = self.look_up(set().union(*chunks))
        return [b"".join([known[c] for c in t]) for t in chunks]
