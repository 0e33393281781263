"""Words of a word-end BPE vocabulary, cut as its library cuts them, and the merges by heap and linked list."""

from __future__ import annotations

import heapq
import json
import re
from functools import cache

from tokenizers import Tokenizer

#: Code points for which the quick cut below equals the library's; tests compare every one of them.
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ]")
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


class Vocabulary:
    """A tokenizers file: BPE with a word-end suffix behind a lower-casing normaliser.

    words() cuts a text as the file's normaliser and pre-tokenizer do. Common Latin text takes one regular
    expression; any other text goes through the library's own normaliser and pre-tokenizer.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self._normalise = self.library.normalizer.normalize_str
        self._cut = self.library.pre_tokenizer.pre_tokenize_str
        self._merge = self.library.model.tokenize
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.known = model["vocab"].keys()
        self.ranks = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.size = max(max(model["vocab"].values()), *self.special_ids.values(), 0) + 1
        # one visible character for each byte: printable Latin-1 stands for itself, the rest follow from 256 on
        self.byte_char, extra = {}, 256
        for b in range(256):
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
                self.byte_char[b] = chr(b)
            else:
                self.byte_char[b], extra = chr(extra), extra + 1

    def segments(self, text: str) -> list[tuple[str | None, list[str]]]:
        """(special string that stands before or None, words) in the order of the text."""
        if "<" not in text or not self._special.search(text):
            return [(None, self.words(text))]
        out, at, before = [], 0, None
        for m in self._special.finditer(text):
            out.append((before, self.words(text[at : m.start()])))
            at, before = m.end(), m.group()
        return [*out, (before, self.words(text[at:]))]

    def words(self, text: str) -> list[str]:
        """Words in lower case as plain text; text holds no special strings."""
        if not _ODD.search(text):
            return _WORD.findall(text.lower())
        plain = self._normalise(text)
        spans = [span for _, span in self._cut(plain)]
        return [plain[a:b] for a, b in spans]

    def ids(self, word: str) -> list[int]:
        """Ids of one word of words(): the library's merges without its normaliser, pre-tokenizer and offsets."""
        plain = word if word.isascii() and word.isprintable() else "".join([self.byte_char[b] for b in word.encode()])
        return [t.id for t in self._merge(plain)]

    def symbols(self, word: str) -> list[str]:
        """The word's bytes as the vocabulary's characters, the last with the word-end suffix."""
        out = [self.byte_char[b] for b in word.encode()]
        if out:
            out[-1] += self.suffix
        return [s for s in out if s in self.known]  # the library drops symbols that it can't name

    def merges(self, word: str) -> tuple[int, int]:
        """(number of initial symbols, number of merges) of one word.

        The symbols form a doubly linked list; a heap holds (rank, place) of adjacent pairs. The lowest rank is
        popped again and again, the leftmost first among equals; entries whose pair has changed are skipped.
        """
        part = self.symbols(word)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, heap, done = self.ranks, [], 0
        for i in range(n - 1):
            if (r := ranks.get((part[i], part[i + 1]))) is not None:
                heap.append((r, i))
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= n or ranks.get((part[i], part[j])) != r:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = k = after[j]
            done += 1
            if k < n:
                before[k] = i
                if (r := ranks.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n, done


@cache
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(path)
