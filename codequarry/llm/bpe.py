"""BPE encoding by backtracking, and decoding by an offset table.

One Aho-Corasick pass over a word finds the longest vocabulary token at each
place. The encoder takes it if merging would keep it apart from the token
before (pair compatibility, cached), else the next shorter token, else it
takes a token back; a place given up once is never entered again, so the work
is linear in the word. The result is exactly that of applying merges in rank
order. Words are cached per worker, in bounded caches.

The tokenizer's file is a parameter; its bytes travel to the tasks in a
broadcast of that file's size; a file that asks for another normaliser, split
pattern or model is refused. Texts beyond Latin letters are normalised by the
library itself, whose version of Unicode decides which marks compose. Null is an empty text, which has no tokens.
Rows are independent, so repeated rows give repeated results, and extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.memory import frugal
from codequarry.llm.hashing import chunks
from codequarry.runtime import ship

#: Moves a word's last symbol out of the others' range: "e" at a word's end is another symbol than "e".
FINAL = 0x1000
CACHE_WORDS, LONGEST_CACHED = 300_000, 64
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Unicode:
    """Code points that the tokenizer's library treats by another version of Unicode than Python: (added, removed) letters
    and numbers, written for a character class."""

    letters: tuple[str, str] = ("", "")
    numbers: tuple[str, str] = ("", "")


@lru_cache(maxsize=4)
def unicode_of(tokenizer: str) -> Unicode:
    """Asks the library's pre-tokeniser of this file about each code point, once."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    # no version of Unicode has characters from U+40000 on, but for tags and private use, which are neither letters nor numbers
    chars = [chr(c) for c in [*range(0x80, 0x40000), *range(0xE0000, 0xE1000)] if not 0xD800 <= c < 0xE000]
    space = set(regex.findall(f"[{SPACE}]", "".join(chars)))
    of_python = {k: set(regex.findall(rf"\p{{{k}}}", "".join(chars))) for k in "LN"}
    of_library = {"L": set(), "N": set()}
    for first in range(0, len(chars), 256):
        part = [c for c in chars[first : first + 256] if c not in space]
        # between letters a letter splits nothing off, between marks nothing but a letter or a number splits anything off
        whole = lambda mark: {p[1] for p in _shown([p for p, _ in t.pre_tokenizer.pre_tokenize_str("\n".join([mark + c + mark for c in part]))]) if len(p) == 3 and p[0] == p[2] == mark}  # noqa: B023, E731
        letters = whole("a")
        of_library["L"] |= letters
        of_library["N"] |= set(part) - letters - whole("!")
    return Unicode(*((written(of_library[k] - of_python[k]), written(of_python[k] - of_library[k])) for k in "LN"))


def written(chars: set[str]) -> str:
    """Characters as ranges of a character class."""
    codes = np.array(sorted(map(ord, chars)), np.int64)
    first = np.flatnonzero(np.diff(codes, prepend=-2) > 1)
    last = np.r_[first[1:], len(codes)] - 1 if len(codes) else first
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(codes[first].tolist(), codes[last].tolist()))


def _shown(pieces: list[str]) -> list[str]:
    """Pieces of byte symbols as the texts they stand for."""
    return "\n".join(pieces).translate(_BYTES).encode("latin-1").decode("utf-8", "replace").split("\n")


#: The one normaliser and split pattern that this encoder knows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Beyond these, composition and lower case follow the library's version of Unicode; below, nothing composes and all versions agree.
BEYOND_LATIN = regex.compile("[^\\x00-\u02ff]")


def checked(d: dict) -> dict:
    """The file's content, if it asks for what this encoder does."""
    split = next((p for p in (d.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
    if d.get("normalizer") != NORMALIZER or split is None or split["pattern"] != {"Regex": PATTERN} or d["model"]["type"] != "BPE":
        raise ValueError("the tokenizer's file has a normaliser, split pattern or model that is not known here")
    return d


def normalizer_of(d: dict):
    """The library's normaliser of a tokenizer's file, without its vocabulary."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json.dumps({"version": "1.0", "normalizer": d["normalizer"], "model": {"type": "BPE", "vocab": {}, "merges": []}})).normalizer


_BYTES = {ord(c): b for b, c in enumerate(byte_symbols())}


class BytePairs:
    """The vocabulary and merges of a byte-level BPE with an end-of-word mark."""

    def __init__(self, spec: str, unicode: Unicode | None = None):
        d = checked(json.loads(spec))
        u = unicode or Unicode()
        self.normalizer = normalizer_of(d)
        model = d["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {a + (b[: -len(self.mark)] + self.mark if b.endswith(self.mark) else b): i for i, (a, b) in enumerate(merges)}
        base = [t for t in vocab if t not in made]
        self.n_base = len(base)
        names = [*base, *(a + b for a, b in merges)]
        rank = {t: i for i, t in enumerate(names)}
        self.ids = [vocab[t] for t in names]
        self.left, self.right, self.merged = [-1] * len(names), [-1] * len(names), {}
        for i, (a, b) in enumerate(merges):
            r = self.n_base + i
            self.left[r], self.right[r] = rank[a], rank[b]
            self.merged[rank[a], rank[b]] = r
        shown = [self.shown(t) for t in names]
        self.length = [len(s) for s in shown]
        self.find = ahocorasick.Automaton()
        for r, s in enumerate(shown):
            self.find.add_word(s, r)
        self.find.make_automaton()
        by_text = {s: r for r, s in enumerate(shown)}
        self.shorter = [next((by_text[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in by_text), -1) for s in shown]
        self.symbols = byte_symbols()
        self.apart: dict[tuple[int, int], bool] = {}
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", []) if t["special"]}
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        letter, number = (rf"[[\p{{{k}}}{a}]--[{b}]]" if b else rf"[\p{{{k}}}{a}]" for k, (a, b) in (("L", u.letters), ("N", u.numbers)))
        pieces = lambda letter, number: regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^{SPACE}{letter}{number}]+")
        self.pieces, self.odd_pieces = pieces(r"\p{L}", r"\p{N}"), pieces(letter, number)
        odd = "".join([*u.letters, *u.numbers])
        self.odd = regex.compile(f"[{odd}]") if odd else None
        self.cache: dict[str, bytes] = {}
        table = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        parts = [table[i].encode() for i in range(max(table) + 1)]
        self.blob = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        self.offset = np.r_[0, np.cumsum([len(p) + 1 for p in parts])]

    def shown(self, token: str) -> str:
        if self.mark and token.endswith(self.mark) and len(token) > len(self.mark):
            token = token[: -len(self.mark)]
            return token[:-1] + chr(ord(token[-1]) + FINAL)
        return token

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging would leave tokens a and b side by side.

        Undoes the latest merge at the seam again and again; a merge across
        the seam that comes before the one just undone would have won. At
        equal rank the left one goes first.
        """
        found = self.apart.get((a, b))
        if found is None:
            x, y, before, found = a, b, len(self.ids) + 1, True
            while True:
                across = self.merged.get((x, y))
                if across is not None and across < before:
                    found = False
                    break
                if max(x, y) < self.n_base:
                    break
                if x > y:
                    before, x = x, self.right[x]
                else:
                    before, y = y + 1, self.left[y]
            if len(self.apart) > CACHE_WORDS:
                self.apart.clear()
            self.apart[a, b] = found
        return found

    def word(self, symbols: str) -> list[int]:
        """Ranks of the tokens of one word, given as symbols with the last one moved to the final range."""
        n = len(symbols)
        longest, size = [-1] * n, self.length
        for end, r in self.find.iter(symbols):
            at = end + 1 - size[r]
            if longest[at] < 0 or size[longest[at]] < size[r]:
                longest[at] = r
        out: list[int] = []
        dead, at, token = bytearray(n + 1), 0, longest[0]
        while at < n:
            end = at + size[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def piece(self, text: str) -> bytes:
        """Ids of a piece between splits, as little-endian unsigned 32-bit integers; cached."""
        found = self.cache.get(text)
        if found is None:
            s = "".join([self.symbols[b] for b in text.encode()])
            if self.mark:
                s = s[:-1] + chr(ord(s[-1]) + FINAL)
            found = np.array([self.ids[r] for r in self.word(s)], "<u4").tobytes()
            if len(text) <= LONGEST_CACHED:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[text] = found
        return found

    def encode(self, text: str) -> bytes:
        if self.split_special and "<|" in text:
            at, out = 0, []
            for m in self.split_special.finditer(text):
                out += [self.plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
                at = m.end()
            return b"".join([*out, self.plain(text[at:])])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if text.isascii() or not BEYOND_LATIN.search(text):
            text = text.lower()
        else:
            text = self.normalizer.normalize_str(text)
        get, piece = self.cache.get, self.piece
        pieces = self.odd_pieces if self.odd and not text.isascii() and self.odd.search(text) else self.pieces
        return b"".join([get(p) or piece(p) for p in pieces.findall(text)])

    def forget(self) -> None:
        """Empties the caches: a worker that goes on to other tasks keeps the tables only."""
        self.cache, self.apart = {}, {}

    def decode(self, ids: bytes) -> bytes:
        """Tokens joined by spaces, gathered from one blob by offsets."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(at):
            return b""
        size = self.offset[at + 1] - self.offset[at]
        ends = np.cumsum(size)
        return self.blob[np.arange(ends[-1]) + np.repeat(self.offset[at] - (ends - size), size)][:-1].tobytes()


_BUILT: dict[str, BytePairs] = {}


def built(spec: str, unicode: Unicode) -> BytePairs:
    key = hashlib.sha256(repr((spec, unicode)).encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = BytePairs(spec, unicode)
    return _BUILT[key]


def _encode(spec):
    def run(batches):
        bpe = built(*spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks([len(t) for t in texts], 1_000_000):
                ids = [bpe.encode(t) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.binary())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )
        bpe.forget()

    return run


def encode(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (UTF-8), by a tokenizer's JSON file."""
    spark = documents.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast((f.read(), unicode_of(tokenizer)))
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(_encode(spec)), "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
