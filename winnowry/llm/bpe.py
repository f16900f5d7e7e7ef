"""BPE encoding and decoding over a prefix trie of distinct words.

The byte-pair encoding of a word ends, for each prefix, in one token; that token and the
state of the prefix before it give the whole encoding.  Distinct words are put in order,
which walks their trie depth-first: the states of a prefix that words share are computed
once.  A token may follow another only if byte-pair merging their joined text gives back
the same two tokens; these answers are kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import wordhash as W
from .packed import give_back, trim, with_columns

_PIECE = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_KEPT_BYTES = 128 << 20
_KEPT_PAIRS = 200_000
_STEP = 1 << 20
# Printable ASCII and Latin letters: composed already, and lower case has the same letters everywhere.
_LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_LONG = 64


def _byte_char(b: int) -> str:
    """The printable character that stands for a byte: itself where it has one, else the next of those from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(b) if b in own else chr(256 + sum(x not in own for x in range(b)))


class TrieBpe:
    """A BPE vocabulary with an end-of-word mark, read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        # tokens read backwards: letters lead on, False and True hold the token inside and at the end of a word
        self._back: dict = {}
        for t, i in self.ids.items():
            body = t.removesuffix(self.end) if self.end else t
            node = self._back
            for c in reversed(body):
                node = node.setdefault(c, {})
            node[len(body) < len(t)] = i
            if not self.end:
                node[True] = i
        # only the parts of the library that cut a text into words are used, not its encoder
        tok = Tokenizer.from_file(path)
        self._normal, self._split = tok.normalizer, tok.pre_tokenizer
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = '"\'s|\'t|\'re|\'ve|\'m|\'ll|\'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"'
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        # the short way below holds for this cut and this normalisation only
        self._short = steps == ["NFC", "Replace", "Lowercase"] and split in json.dumps(spec.get("pre_tokenizer"))
        self.bytes = str.maketrans({chr(c): "".join(_byte_char(b) for b in chr(c).encode()) for c in range(0xC0, 0x100)})
        self._follows: dict[tuple[int, int], bool] = {}
        self._symbols: dict[int, list[int]] = {}
        self._whole: dict[int, bool] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """Plain byte-pair merging: the lowest rank first, the leftmost of equals."""
        s = list(symbols)
        while len(s) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            s[i : i + 2] = [self.merges[(s[i], s[i + 1])][1]]
        return s

    def symbols(self, token: int) -> list[int]:
        out = self._symbols.get(token)
        if out is None:
            t = self.text[token]
            body = t.removesuffix(self.end) if self.end else t
            out = [self.ids[c] for c in body]
            if len(body) < len(t):
                out[-1] = self.ids[body[-1] + self.end]
            self._symbols[token] = out
        return out

    def whole(self, token: int) -> bool:
        """Whether merging a token's symbols gives back the token."""
        got = self._whole.get(token)
        if got is None:
            got = self._whole[token] = self.merged(self.symbols(token)) == [token]
        return got

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the joined symbols of two tokens gives back these tokens."""
        got = self._follows.get((a, b))
        if got is None:
            if len(self._follows) > _KEPT_PAIRS:
                self._follows.clear()
            got = self._follows[(a, b)] = self.merged(self.symbols(a) + self.symbols(b)) == [a, b]
        return got

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of words in the byte alphabet of the vocabulary, by a walk of their trie."""
        out: dict[str, tuple[int, ...]] = {}
        ids, follows, whole, back, end, known = self.ids, self.follows, self.whole, self._back, self.end, self._follows
        before, last = "", [-1]  # last[i]: the token that ends the encoding of the first i characters
        size = [0]
        for word in sorted(set(words)):
            if not word:
                out[word] = ()
                continue
            shared = 0
            top = min(len(before), len(word) - 1, len(last) - 1)
            while shared < top and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                node, j, final = back, i, i == len(word)
                while j:
                    j -= 1
                    node = node.get(word[j])
                    if node is None:
                        last.append(-1)
                        size.append(0)
                        break
                    t = node.get(final)
                    if t is None:
                        continue
                    if j:
                        pair = (last[j], t)
                        ok = known.get(pair)
                        if ok is None:
                            ok = pair[0] >= 0 and follows(*pair)
                    else:
                        ok = whole(t)
                    if ok:
                        last.append(t)
                        size.append(i - j)
                        break
                else:
                    last.append(-1)
                    size.append(0)
            path, i = [], len(word)
            while i > 0 and last[i] >= 0:
                path.append(last[i])
                i -= size[i]
            if i:  # a prefix of the word has no encoding of its own
                path = self.merged([ids[c] for c in word[:-1]] + [ids[word[-1] + end]])[::-1]
            out[word] = tuple(reversed(path))
            del last[-1], size[-1]  # the end of a word is a leaf
            before = word
        return out

    def pieces(self, piece: str) -> list[str | int]:
        """The words of a text without blanks: lower-case words of the short way, others in the byte alphabet after a line feed; special tokens as ids."""
        if self._short and _LATIN.fullmatch(piece) and "<|" not in piece:
            return [piece.lower()] if piece.isalpha() else _WORD.findall(piece.lower())
        out: list[str | int] = []
        for part in self._special.split(piece) if self._special and "<|" in piece else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += ["\n" + w for w, _ in self._split.pre_tokenize_str(self._normal.normalize_str(part)) if w]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Token texts joined by a space, as a tokenizer file without a decoder has them."""
        return " ".join(self.text[i] for i in ids)


class Words:
    """Encodings of pieces and words met before, bounded in bytes: decimal ids and token texts, each joined by one space, with a line feed between.

    A word of the short way is a piece that has itself as its only word, so both share the table; a word of the library's
    splitter has a line feed before it.  New entries fill one half of the room; when it is full the other half, which
    holds what has not been met since, is forgotten.
    """

    def __init__(self, path: str) -> None:
        self.bpe, self._new, self._old, self._size = TrieBpe(path), {}, {}, 0
        self._long: set[str] = set()

    def _keep(self, key: str, value: str) -> None:
        self._new[key] = value
        self._size += 220 + len(key) + len(value)
        if len(key) > _LONG:
            self._long.add(key)

    def _missing(self, keys: set[str]) -> set[str]:
        """Those of ``keys`` that have no entry; entries of the older half move to the newer one."""
        rest, old = keys - self._new.keys(), self._old
        moved = rest & old.keys()
        for k in moved:
            self._keep(k, old.pop(k))
        return rest - moved

    def _forget(self) -> None:
        """After a slice: long entries go, and the older half if the newer one is full."""
        for k in self._long:
            self._size -= 220 + len(k) + len(self._new.pop(k))
        self._long.clear()
        if self._size > _KEPT_BYTES // 2:
            self._old, self._new, self._size = self._new, {}, 0

    def _learn(self, pieces: set[str]) -> None:
        """Entries of pieces not met before; their new words are encoded in one walk."""
        bpe, keep = self.bpe, self._keep
        cut = {p: bpe.pieces(p) for p in pieces}
        new = self._missing({w for ws in cut.values() for w in ws if isinstance(w, str)})
        spelt = {w: w[1:] if w[0] == "\n" else w if w.isascii() else w.translate(bpe.bytes) for w in new}
        encoded, text = bpe.encode_words(spelt.values()), bpe.text
        for w, letters in spelt.items():
            ids = encoded[letters]
            keep(w, f"{ids[0]}\n{text[ids[0]]}" if len(ids) == 1 else f"{' '.join(map(str, ids))}\n{' '.join([text[i] for i in ids])}")
        known = self._new
        for p, ws in cut.items():
            if p not in known:
                of = [(known[w] if isinstance(w, str) else f"{w}\n{text[w]}") for w in ws]
                if len(of) == 1:
                    keep(p, of[0])
                else:
                    halves = "\n".join(of).split("\n")
                    keep(p, f"{' '.join(halves[::2])}\n{' '.join(halves[1::2])}")

    def encoded(self, texts: list[list[str]]) -> Iterator[tuple[str, str]]:
        """For each text, given as its pieces, ids and token texts."""
        pieces = set().union(*texts)
        missing = self._missing(pieces)
        if missing:
            self._learn(missing)
        known = self._new
        none = {p for p in missing if known[p] == "\n"}  # white space that ASCII does not have, never kept
        for ps in texts:
            if none:
                ps = [p for p in ps if p not in none]
            halves = "\n".join(map(known.__getitem__, ps)).split("\n")
            yield " ".join(halves[::2]), " ".join(halves[1::2])
        for p in none:
            self._long.add(p)
        self._forget()


_loaded: dict[str, Words] = {}


def encoded_texts(texts: list[str | None], path: str) -> Iterator[tuple[str, str]]:
    """For each text the decimal ids and the token texts, each joined by one space."""
    if path not in _loaded:
        _loaded[path] = Words(path)
        give_back()  # the parsed file, and what an earlier step left in this worker
    yield from _loaded[path].encoded([_PIECE.findall(t or "") for t in texts])


def encode(
    docs: DataFrame, path: str | Callable[[], str], text_col: str = "text", ids: bool = True, decoded: bool = True
) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256; with ``ids`` the token ids, with ``decoded`` their text.

    ``path`` names a tokenizer file that every executor can open (a function is called there).
    Special tokens written out in a text become their ids, as the library does by default.
    Defined cases: null and empty texts have no tokens; other columns pass through, and
    input columns named like the added ones are replaced; no rows give no rows.
    """
    adds = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded

    def fill(column: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        where = path() if callable(path) else path
        _, at = W.utf8(column)
        for i, j in W.slices(at, _STEP):
            n, one, two, flat, texts = [], [], [], [], []
            for a, b in encoded_texts(column.slice(i, j - i).to_pylist(), where):
                n.append(a.count(" ") + 1 if a else 0)
                one.append(hashlib.sha256(a.encode()).hexdigest())
                two.append(hashlib.sha256(b.encode()).hexdigest())
                if ids:
                    flat.append(np.fromstring(a, np.int32, sep=" ") if a else np.zeros(0, np.int32))
                if decoded:
                    texts.append(b)
            out = [pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            if ids:
                ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat))))
            yield j - i, out + [pa.array(texts, pa.string())] * decoded
            del n, one, two, flat, texts, out
            trim()

    return with_columns(docs, text_col, adds, fill)
