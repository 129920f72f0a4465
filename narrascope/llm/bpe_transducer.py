"""BPE encoding and decoding as streaming transducers.

Encoding reads symbols from left to right. For each prefix of a word exactly one last token is right: the one that ends
there and stands next to the last token of what is before it, where two tokens may stand side by side if merging
both together leaves just these two. Later symbols can only choose among the last few prefixes, so a token is
stable, and is emitted, once the readings of all prefixes within reach of a token agree on it. How far ahead of a
stable token the reading can get is bounded by the merge list (Berglund and van der Merwe 2023): see `lookahead`.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from operator import itemgetter
from typing import Any

import regex
from pyspark.sql import DataFrame

from narrascope.llm.spark import with_scores

#: Fixed values of the tokenizer's file format: its pre-tokenising pattern, with white space spelled out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}" + SPACE + "]+")
#: Words of a worker's memory, and the longest word kept there.
MEMORY, KEPT = 400_000, 48
#: Ids that go from the encoder to the digests and the decoder at a time, and characters that are split at a time.
BATCH, STRETCH = 4096, 1 << 14


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """A merge list: ids and ranks of tokens, which tokens may stand side by side, and the lookahead."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str):
        self.ids, self.end = vocab, end
        self.parts = {a + b: (a, b) for a, b in merges}
        self.rank = {pair: i for i, pair in enumerate(self.parts.values())}
        single = set(byte_symbols())
        self.tokens = {*single, *(s + end for s in single), *self.parts}
        self.longest = max(self.size(t) for t in self.tokens)
        self.edges = {t[i:] for t in self.tokens for i in range(self.size(t))}
        self.lookahead = self._sufficient_lookahead()
        self._beside: dict[tuple[str, str], bool] = {}

    def size(self, token: str) -> int:
        """Symbols of a token; the end mark belongs to the last one."""
        return len(token) - (len(self.end) if token.endswith(self.end) else 0)

    def _sufficient_lookahead(self) -> int:
        """A bound on how far a merge can depend on symbols to its right.

        A merge (a, b) can be kept from happening by an earlier rule that takes b, or a part at the right edge of
        b, together with what follows; that rule in turn by a still earlier one. The longest such chain
        of rules, found in one pass in rank order, times the longest token bounds the distance.
        """
        chains: dict[str, int] = {}
        deepest = 1
        for a, b in self.parts.values():
            # The longest chain of earlier rules whose left part is b or lies at the right edge of b.
            length, part = 1 + chains.get(b, 0), b
            while part in self.parts:
                part = self.parts[part][1]
                length = max(length, 1 + chains.get(part, 0))
            chains[a] = max(chains.get(a, 0), length)
            deepest = max(deepest, length)
        return (deepest + 1) * self.longest

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging: the earliest rule first, leftmost first."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, at = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def symbols(self, token: str) -> list[str]:
        marked = token.endswith(self.end)
        found = list(token[:-len(self.end)] if marked else token)
        if marked:
            found[-1] += self.end
        return found

    def beside(self, a: str, b: str) -> bool:
        """Whether merging the symbols of both together leaves just these two tokens."""
        key = (a, b)
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) > MEMORY:
                self._beside.clear()
            known = self._beside[key] = self.merge([*self.symbols(a), *self.symbols(b)]) == [a, b]
        return known


class Encoder:
    """Reads the symbols of one word one by one and gives out tokens as soon as they are stable.

    It keeps the last tokens of the prefixes behind the last stable token only. `peak` is the largest number of
    these so far; it stays within the lookahead of the merge list, however long the word is.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.symbols: list[str] = []
        self.last: list[str] = []
        self.before: str | None = None
        self.peak = 0

    def feed(self, symbol: str) -> list[str]:
        """Take one symbol; give the tokens that became stable."""
        merges, symbols, last = self.merges, self.symbols, self.last
        symbols.append(symbol)
        text = ""
        for start in range(len(symbols) - 1, -1, -1):
            text = symbols[start] + text
            if text not in merges.edges:
                break
            if text in merges.tokens:
                left = last[start - 1] if start else self.before
                if left is None or merges.beside(left, text):
                    last.append(text)
                    break
        if len(last) != len(symbols):
            raise ValueError("not a merge list: a prefix has no reading")
        if len(last) % merges.longest or len(last) == merges.longest:
            return []
        self.peak = max(self.peak, len(last))
        stable = self._stable()
        if len(self.last) > merges.lookahead:
            raise ValueError("not a merge list: a prefix is open beyond its lookahead")
        return stable

    def finish(self) -> list[str]:
        """The tokens that are left at the end of the word."""
        return self._take(len(self.last))

    def _cuts(self, end: int) -> set[int]:
        """Where the reading of a prefix cuts it, its end included."""
        cuts = set()
        while end > 0:
            cuts.add(end)
            end -= self.merges.size(self.last[end - 1])
        return cuts

    def _stable(self) -> list[str]:
        """The tokens before the last cut that all prefixes have which a later token can follow."""
        size = len(self.last)
        shared = set.intersection(*(self._cuts(end) for end in range(size - self.merges.longest + 1, size + 1)))
        return self._take(max(shared)) if shared else []

    def _take(self, cut: int) -> list[str]:
        found, end = [], cut
        while end:
            found.append(self.last[end - 1])
            end -= self.merges.size(self.last[end - 1])
        if found:
            self.before = found[0]
        del self.symbols[:cut], self.last[:cut]
        return found[::-1]


class Decoder:
    """Turns ids into text piece by piece: bytes of unfinished characters are kept until the next id.

    With `joined`, pieces are the token strings with a space between, as a tokenizer without decoder gives them.
    Otherwise they are the text itself: end marks become spaces, and bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, codec: Codec, joined: bool = False):
        self.codec, self.joined, self.first = codec, joined, True
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.joined:
            pieces = " ".join(map(self.codec.names.__getitem__, ids))
            text = pieces if self.first or not pieces else " " + pieces
            self.first = self.first and not pieces
            return text
        return self.bytes.decode(b"".join(map(self.codec.raw.__getitem__, ids)))

    def finish(self) -> str:
        return "" if self.joined else self.bytes.decode(b"", final=True)


def _words(text: str) -> Iterator[Iterable[str]]:
    """The words of a text in lists of bounded stretches, which end at blanks. Where none is near they come one by one."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + STRETCH)
        end = len(text) if end < 0 else end
        yield WORDS.findall(text, at, end) if end - at <= 2 * STRETCH else map(itemgetter(0), WORDS.finditer(text, at, end))
        at = end


class _Words(dict):
    """Ids of the words met lately. When full it becomes the elder half, from which words still in use are taken over.

    Words of more than `KEPT` characters are not kept: their ids come one by one.
    """

    def __init__(self, encode: Callable[[str], Iterator[int]]):
        super().__init__()
        self.encode, self.elder = encode, {}

    def __missing__(self, word: str) -> Iterable[int]:
        if len(word) > KEPT:
            return self.encode(word)
        found = self.elder.get(word)
        if found is None:
            found = tuple(self.encode(word))
        if len(self) >= MEMORY:
            self.elder = dict(self)
            self.clear()
        self[word] = found
        return found


class Codec:
    """A tokenizer file of byte-level BPE with an end-of-word mark, lower-casing and special tokens."""

    def __init__(self, file_text: str):
        data = json.loads(file_text)
        model = data["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.symbols = byte_symbols()
        self.names = {i: t for t, i in {**model["vocab"], **self.special}.items()}
        value = {s: b for b, s in enumerate(self.symbols)}
        self.raw = {i: self._bytes(t, value) for i, t in self.names.items()}
        self.words = _Words(self.stream_word)

    def _bytes(self, token: str, value: dict[str, int]) -> bytes:
        if token in self.special:
            return token.encode()
        marked = token.endswith(self.merges.end)
        return bytes(value[c] for c in (token[:-len(self.merges.end)] if marked else token)) + b" " * marked

    def stream_word(self, word: str) -> Iterator[int]:
        """Ids of one word, each given out as soon as it is stable."""
        encoder, ids = Encoder(self.merges), self.merges.ids
        raw = word.encode("utf-8", "replace")
        for b in raw[:-1]:
            for token in encoder.feed(self.symbols[b]):
                yield ids[token]
        for token in chain(encoder.feed(self.symbols[raw[-1]] + self.merges.end), encoder.finish()):
            yield ids[token]

    def stream(self, text: str) -> Iterator[Iterable[int]]:
        """Ids of a text, word by word; those of long words one by one, as they become stable."""
        for i, part in enumerate(self.split.split(text) if "<|" in text else [text]):
            if i % 2:
                yield (self.special[part],)
                continue
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            # Lower-casing goes character by character, so a sigma never becomes a final one.
            for words in _words(part.replace("\u03a3", "\u03c3").lower()):
                yield chain.from_iterable(map(self.words.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.stream(text))) if text else []

    def decode(self, ids: Iterable[int], joined: bool = False) -> str:
        decoder = Decoder(self, joined)
        return decoder.feed(ids) + decoder.finish()


@functools.lru_cache(maxsize=2)
def codec_of(file_text: str) -> Codec:
    """One codec for each worker and file."""
    return Codec(file_text)


def read_file(path: str | None = None) -> str:
    """The tokenizer file; without a path the public word-level BPE of 49k tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_texts(docs: DataFrame, text: str = "text", out: str = "tokens", path: str | None = None) -> DataFrame:
    """Add a struct column (ids). Null and empty texts have no ids; every text is read whole."""
    file_text = read_file(path)

    def make() -> Callable[[str | None], tuple[Any, ...]]:
        codec = codec_of(file_text)
        return lambda t: (codec.encode(t),)

    return with_scores(docs, text, out, make, "ids array<int>")


def decode_ids(docs: DataFrame, ids: str, out: str = "decoded", joined: bool = False, path: str | None = None) -> DataFrame:
    """Add a struct column (text) of the decoded ids; a null array gives the empty text."""
    file_text = read_file(path)

    def make() -> Callable[[Any], tuple[Any, ...]]:
        codec = codec_of(file_text)
        return lambda x: (codec.decode([] if x is None else x, joined),)

    return with_scores(docs, ids, out, make, "text string")


def digests(docs: DataFrame, text: str = "text", out: str = "bpe", path: str | None = None) -> DataFrame:
    """Add a struct column (n_tokens, ids_sha256, decoded_sha256) of each whole text. Null counts as the empty text.

    Ids pass from the encoder through the decoder into running digests, `BATCH` at a time, so that besides the text
    itself no memory grows with its length.
    """
    file_text = read_file(path)

    def make() -> Callable[[str | None], tuple[Any, ...]]:
        codec = codec_of(file_text)
        numbers = {i: str(i) for i in codec.names}

        def digest(value: str | None) -> tuple[Any, ...]:
            ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
            decoder, ids = Decoder(codec, joined=True), chain.from_iterable(codec.stream(value or ""))
            while batch := list(islice(ids, BATCH)):
                ids_sha.update(((" " if n else "") + " ".join(map(numbers.__getitem__, batch))).encode())
                text_sha.update(decoder.feed(batch).encode())
                n += len(batch)
            text_sha.update(decoder.finish().encode())
            return n, ids_sha.hexdigest(), text_sha.hexdigest()

        return digest

    return with_scores(docs, text, out, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_query(docs: DataFrame) -> DataFrame:
    """The contract of op3."""
    return digests(docs.select("doc_id", "text")).select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")
