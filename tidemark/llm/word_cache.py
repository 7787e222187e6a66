"""Token ids of whole texts through the tokenizers library, with each distinct word encoded once per worker.

Both vocabularies cut a text before every single space or line break that follows a visible character,
and before a full stop or comma that follows a letter or digit. So a text is the concatenation of such
words, and a word seen before needs no second call. Texts for which that cannot be said with certainty
(other white space, runs of white space or punctuation, special strings) go to the library whole. New
words go to it many at a time; their ends are read off the ids: a token that begins with the space, or
that ends a word, or a special token set between them.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

from tidemark.llm.common import keep_only, kept

#: What a worker's table of known words may hold, and the longest word in it: 700,000 of 64 characters at most.
_ENTRIES, _LETTERS = 700_000, 64
_ODD = re.compile("[\x01\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u0130\u03a3\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: A full stop or comma behind anything but a letter or digit; it begins with what is rare, so the search is fast.
_RUN = re.compile(r"[.,](?<=[\W_].)")


class _Known(dict):
    """Ids by word. One that is not there is None, and is noted in fresh, once each time it is looked up."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> None:
        self.fresh.append(word)


class WordEncoder:
    """encode_bytes(texts): the ids of each text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, entries: int = _ENTRIES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark, self.mark_id = self.special[0], self.tokenizer.token_to_id(self.special[0])
        vocab = self.tokenizer.get_vocab()
        self.word_ends = "a</w>" in vocab
        self.edge = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.edge[[i for t, i in vocab.items() if (t.endswith("</w>") if self.word_ends else t.startswith("Ġ"))]] = True
        self.entries = entries
        self.words = _Known()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, each led by a space, or by what stands after \\x01 alone."""
        out: dict[str, bytes] = {}
        plain = [w for w in words if w.isalpha() and (w.isascii() or w.lower().isalpha())]
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = self._ids(" " + " ".join(some))
            where = np.flatnonzero(self.edge[ids])
            cuts = (where + 1 if self.word_ends else np.append(where[1:], len(ids))) * 4
            if len(cuts) != len(some):
                out.update(zip(some, self._library([" " + w for w in some])))
                continue
            raw, begin = ids.tobytes(), 0
            for w, end in zip(some, cuts.tolist()):
                out[w] = raw[begin:end]
                begin = end
        rest = [w for w in words if w not in out]
        for at in range(0, len(rest), 500):
            some = rest[at : at + 500]
            ids = self._ids(self.mark.join([w[1:] if w[:1] == "\x01" else " " + w for w in some]))
            raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.mark_id) * 4).tolist()
            for w, a, b in zip(some, [0, *(c + 4 for c in ends)], [*ends, len(raw)]):
                out[w] = raw[a:b]
        return out

    def _plain(self, text: str) -> bool:
        if self.word_ends and not text.isascii() and not unicodedata.is_normalized("NFC", text):
            return False
        return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(x in text for x in self.special) or _ODD.search(text) or _RUN.search(text))

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        known = self.words
        gaps: list[tuple[int, list[bytes | None], list[str]]] = []
        whole: list[int] = []
        for i, t in enumerate(texts):
            if t:
                if self._plain(t):
                    if self.word_ends:  # this vocabulary is of lower case, so fewer words are new
                        t = t.lower()
                    known.fresh = []
                    parts = list(map(known.__getitem__, ("\x01" + t).replace("\n", " \x01\n").replace(".", " \x01.").replace(",", " \x01,").split(" ")))
                    if known.fresh:
                        gaps.append((i, parts, known.fresh))
                    else:
                        out[i] = b"".join(parts)
                else:
                    whole.append(i)
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = ids
        missing = list(dict.fromkeys(w for _, _, fresh in gaps for w in fresh))
        learned = self._learn(missing) if missing else {}
        for i, parts, fresh in gaps:
            at = -1
            for w in fresh:  # in the order of their gaps
                at = parts.index(None, at + 1)
                parts[at] = learned[w]
            out[i] = b"".join(parts)
        if len(known) + len(learned) <= self.entries:
            known.update((w, ids) for w, ids in learned.items() if len(w) <= _LETTERS)
        return out


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary; what other operators keep there goes."""
    keep_only("words")
    loaded = kept("words")
    if path not in loaded:
        loaded.clear()
        loaded[path] = WordEncoder(path)
    return loaded[path]
