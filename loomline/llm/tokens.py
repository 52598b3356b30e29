"""Token ids of whole batches of texts with a public byte-level BPE vocabulary.

The tokenizers library gives the ids. Because its encoder works word by word, each distinct word is encoded once
and kept; a batch is cut into the pre-tokenizer's words by array operations on code points, words are told apart
by 64-bit hashes, and the ids of all words are gathered at once. Texts with an apostrophe contraction or with a
special token's string go through the library whole.
"""

from __future__ import annotations

import os

import numpy as np

#: Distinct words whose ids a worker keeps, beyond which the store starts anew; code points that are cut into words at once.
MOST_WORDS, STEP = 500_000, 400_000

_LETTER, _NUMBER, _SPACE = 1, 2, 3


class BatchTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.odd = regex.compile("'(?:[stmd]|re|ve|ll)" + "".join("|" + regex.escape(s) for s in self.special))
        every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
        self.kind = np.zeros(0x110000, np.uint8)
        for code, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1])
                self.kind[a : b + 1] = code
        rng = np.random.default_rng(3)
        self.base = np.uint64(int(rng.integers(1 << 62)) | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.power = self.unpower = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        # hashes of known words, sorted, and the numbers of these words: 16 bytes a word, looked up for many at once
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 1 << 19)
            for name, b in (("power", self.base), ("unpower", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.uint32)
            elif ("'" in t or any(s in t for s in self.special)) and self.odd.search(t):
                out[i] = self.whole(t)
            else:
                plain.append(i)
        at = 0
        while at < len(plain):
            size, first = 0, at
            while at < len(plain) and (at == first or size + len(texts[plain[at]]) <= STEP):
                size += len(texts[plain[at]])
                at += 1
            part = plain[first:at]
            for i, ids in zip(part, self._encode([texts[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(n + 1, bool)
        first[0] = True
        first[ends] = True
        kind = self.kind[code]
        cut = np.empty(n + 1, bool)
        cut[0] = cut[n] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
        space = kind == _SPACE
        # a space before something else belongs to it, and so begins a word even after other white space
        cut[1:n][(code[:-1] == 32) & ~space[1:]] = False
        cut[: n - 1] |= space[:-1] & ~space[1:] & ~first[1:n]
        cut |= first
        edge = np.flatnonzero(cut)
        a, b = edge[:-1], edge[1:]
        self._powers(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=run[1:])
        h = (run[b] - run[a]) * self.unpower[a]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        unique, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > MOST_WORDS:
            self.clear()
        at = np.searchsorted(self.known, unique)
        number = np.full(len(unique), -1, np.int64)
        hit = np.flatnonzero(at < len(self.known))
        hit = hit[self.known[at[hit]] == unique[hit]]
        number[hit] = self.number[at[hit]]
        if len(new := np.flatnonzero(number < 0)):
            number[new] = self._learn([joined[x:y] for x, y in zip(a[where[new]].tolist(), b[where[new]].tolist(), strict=True)])
            self.known, self.number = np.insert(self.known, at[new], unique[new]), np.insert(self.number, at[new], number[new])
        word = number[back]
        count = self.count[word]
        total = np.zeros(len(word) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = self.flat[np.repeat(self.start[word] - total[:-1], count) + np.arange(total[-1])]
        upto = total[np.searchsorted(a, ends)]
        return np.split(ids, upto[:-1])

    def _learn(self, words: list[str]) -> np.ndarray:
        found = [e.ids for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]
        first, n = len(self.known), len(found)
        counts = np.fromiter(map(len, found), np.int64, n)
        need = self.used + int(counts.sum())
        if need > len(self.flat):
            self.flat = np.resize(self.flat, max(need, 2 * len(self.flat)))
        while first + n > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        self.flat[self.used : need] = np.fromiter((x for ids in found for x in ids), np.uint32, need - self.used)
        self.start[first : first + n] = self.used + np.cumsum(counts) - counts
        self.count[first : first + n] = counts
        self.used = need
        return np.arange(first, first + n)


_made: dict[str, BatchTokenizer] = {}


def tokenizer(path: str) -> BatchTokenizer:
    """One for each worker process and file."""
    if path not in _made:
        _made[path] = BatchTokenizer(path)
    return _made[path]
