"""BPE encoding over a trie of distinct words, and decoding.

The words of a corpus share prefixes, and so do their encodings: the last token
of a prefix's encoding follows from states of shorter prefixes alone.  For a
prefix of i symbols, exactly one vocabulary token that ends at i can be last:
the one that does not merge back into the encoding of what precedes it.  The
encoder walks the sorted distinct words depth-first, which is a walk over their
trie, keeps one state for each symbol of the current path, and so computes every
shared prefix once.

Texts are normalised and cut into words by the tokenizer's own rules; distinct
words of a batch go through the trie, and finished ones stay in a bounded cache.

Defined cases: a null or empty text has no ids and decodes to the empty string; rows that
repeat a doc_id, or have none, are encoded each on its own; an empty table gives no rows;
other columns of ``docs``, whatever their names, are ignored.  A symbol that the vocabulary
lacks is an error, and so is a tokenizer file whose rules are not those this module follows.
Rows are independent: nothing is shuffled, no key can be hot, and a worker's memory is
bounded by its cache, in number and length of words, and one chunk of text, or one very
long text, which is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, map_arrow, texts

#: Words that a worker remembers; beyond that it starts anew.
CACHE_WORDS = 450_000
#: Longer words are encoded anew in each batch.
WORD_LENGTH = 256

#: Characters on whose classes every regular expression engine agrees.
PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\u024f]")


class TrieEncoder:
    """Encodes words of one BPE vocabulary with a word-end suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.vocab, self.suffix = vocab, suffix
        self.text = {i: t for t, i in vocab.items()}
        self.rank = {pair: i for i, pair in enumerate(merges)}
        # how long a token can be that ends in given three symbols, with and without the word end
        self.reach: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for token in vocab:
            closing = bool(suffix) and token.endswith(suffix) and token != suffix
            body = token[: -len(suffix)] if closing else token
            reach = self.reach[closing]
            reach[body[-3:]] = max(len(body), reach.get(body[-3:], 0))
        self.together: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        """The symbols a token is made of; the word end belongs to the last one."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = list(token[: -len(self.suffix)])
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """Plain BPE by lowest rank, leftmost first."""
        while len(parts) > 1:
            best = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(pairwise(parts)))
            if best[0] == len(self.rank):
                break
            i = best[1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        return parts

    def stays(self, left: str, right: str) -> bool:
        """Whether two tokens side by side stay as they are."""
        if (known := self.together.get((left, right))) is None:
            if len(self.together) > 2_000_000:
                self.together.clear()
            known = self.together[left, right] = self.merged(self.symbols(left) + self.symbols(right)) == [left, right]
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of every distinct word, by a depth-first walk over their trie.

        ``states[i]`` is the last token of the encoding of the path's first i symbols.
        """
        out: dict[str, list[int]] = {}
        vocab, suffix, together, stays = self.vocab, self.suffix, self.together, self.stays
        inside, ending = self.reach
        path, states = "", [""]
        for word in sorted(set(words)):
            size = len(word)
            inner = size - 1 if suffix else size
            shared, most = 0, min(inner, len(states) - 1)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, size + 1 if suffix else inner + 1):
                if end > inner:
                    closing, reach = suffix, ending.get(word[end - 3 if end > 3 else 0 : end], 2)
                else:
                    closing, reach = "", inside.get(word[end - 3 if end > 3 else 0 : end], 2)
                for start in range(end - reach if end > reach else 0, end):
                    token = word[start:end] + closing
                    if token in vocab:
                        if start == 0:
                            break
                        left = states[start]
                        fits = together.get((left, token))
                        if stays(left, token) if fits is None else fits:
                            break
                else:
                    raise KeyError(word)
                if not closing:
                    states.append(token)
            path = word[:inner]
            if not suffix:
                token = states[size]
            ids, at = [vocab[token]], start if suffix else size - len(token)
            while at > 0:
                token = states[at]
                ids.append(vocab[token])
                at -= len(token)
            ids.reverse()
            out[word] = ids
        return out


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte, by the published byte-level rule: printable
    Latin-1 characters stand for themselves, the others for 256, 257, ... in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordCodec:
    """Encodes and decodes texts word by word with a bounded cache."""

    def __init__(self, path: str, cache: int = CACHE_WORDS) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", ())]
        rules = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", ())]
        if model["type"] != "BPE" or steps != ["Split", "ByteLevel"] or "Lowercase" not in rules or spec["decoder"] is not None:
            raise ValueError("the tokenizer's rules are not those of a lower-casing word BPE over byte letters")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.trie = TrieEncoder(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # the same rules for lower-case ASCII, in an engine that is faster there
        rules = self.pattern.pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]")
        self.plain = re.compile(rules.replace(r"\p{L}\p{N}", "a-z0-9"), re.ASCII)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.names = {**self.trie.text, **{i: t for t, i in self.special.items()}}
        self.packed = {i: i.to_bytes(4, "little") for i in self.names}
        self.alphabet = byte_alphabet()
        self.cache = cache
        self.known: dict[str, tuple[bytes, str]] = {}  # ids and tokens of a word
        self.long: list[str] = []  # words that are forgotten after their batch

    def words(self, text: str) -> list[str]:
        """Words by the tokenizer's own rules; a special token stays one with a NUL before it."""
        if "<|" in text and self.at_special.search(text):
            parts = self.at_special.split(text)
            return [w for x in parts for w in (["\0" + x] if x in self.special else self.words(x))]
        if text.isascii():
            return self.plain.findall(text.lower())
        clean = self.library.normalizer.normalize_str(text)
        if PLAIN.search(clean) is None:
            return self.pattern.findall(clean)
        back = {c: b for b, c in self.alphabet.items()}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(clean)
        return [bytes(back[c] for c in w).decode("utf-8") for w, _ in pieces]

    def learn(self, words: set[str]) -> None:
        """Puts ids and tokens of unknown words into the cache."""
        for w in self.long:
            self.known.pop(w, None)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.cache:
            self.known, new = {}, list(words)
        alphabet = self.alphabet
        as_bytes = {
            w: w if w.isascii() and w.isprintable() else "".join([alphabet[b] for b in w.encode("utf-8")])
            for w in new
            if w[0] != "\0" or w[1:] not in self.special
        }
        found = self.trie.encode_words(as_bytes.values())
        for w in new:
            own = found[as_bytes[w]] if w in as_bytes else [self.special[w[1:]]]
            self.known[w] = (b"".join([self.packed[i] for i in own]), " ".join([self.names[i] for i in own]))
        self.long = [w for w in new if len(w) > WORD_LENGTH]

    def encode(self, batch: list[str]) -> list[tuple[int, bytes, str]]:
        """(token count, ids as little-endian unsigned 32-bit integers, decoded text) of each text.

        The vocabulary comes without a decoder, so decoding joins tokens by blanks.
        """
        cut = [self.words(t) for t in batch]
        self.learn(set().union(*cut))
        out = []
        for x in cut:
            got = [self.known[w] for w in x]
            ids = b"".join([g[0] for g in got])
            out.append((len(ids) // 4, ids, " ".join([g[1] for g in got])))
        return out


@lru_cache(maxsize=2)
def codec(path: str, cache: int = CACHE_WORDS) -> WordCodec:
    """One codec in each worker."""
    return WordCodec(path, cache)


def encode_documents(docs: DataFrame, tokenizer_path: str, cache: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids binary, decoded string) of every document; ``cache`` words cost
    a worker about 0.8 MB a thousand."""
    return _run(docs, tokenizer_path, False, cache)


def digest_documents(docs: DataFrame, tokenizer_path: str, cache: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests of :func:`encode_documents`,
    taken in the worker so that ids and texts need not leave it."""
    return _run(docs, tokenizer_path, True, cache)


def _run(docs: DataFrame, path: str, digest: bool, cache: int) -> DataFrame:
    kinds = ("ids_sha256 string, decoded_sha256 string") if digest else ("ids binary, decoded string")
    names = re.findall(r"(\w+) (?:string|binary)", kinds)
    types = [pa.int64(), pa.int64(), pa.string() if digest else pa.binary(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, cache)
        finish: Callable = lambda n, ids, text: (n, ids, text)
        if digest:
            finish = lambda n, ids, text: (
                n,
                hashlib.sha256(ids).hexdigest(),
                hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
            )
        for batch in chunks(batches, limit=2 << 20):
            rows = [finish(*x) for x in own.encode(batch.column("text").to_pylist())]
            columns = [batch.column("doc_id").to_pylist(), *zip(*rows, strict=True)]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_tokens", *names]
            )

    return map_arrow(texts(docs), work, f"doc_id long, n_tokens long, {kinds}")
