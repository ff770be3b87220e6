"""Token ids of whole texts, by a public vocabulary file, inside Spark tasks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from topictide.llm.texts import worker_memo

#: Words kept with their ids in one worker; the memo starts anew beyond it.
MEMO_WORDS = 450_000
#: Longer pieces between blanks are encoded each time.
MEMO_CHARS = 40
#: Characters of the texts that are encoded together; a longer text is encoded alone.
BATCH_CHARS = 8 << 20
#: A comma or full stop after a letter and before white space is a word of its own.
LATIN_ENDS = re.compile(r"(?<=[a-zß-öø-ÿ])([,.])(?=[ \n])")


def _plain_case(text: str) -> str:
    """The text in lower case, where that is sure to change no id: in Latin-1 without special tokens."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return LATIN_ENDS.sub(r" \1", text.lower())


class WordEncoder:
    """Encodes the different words of many texts once, and puts the texts' ids together.

    The vocabulary's rules never look across white space, split letters from a following
    comma or full stop, and ignore case, so the ids of a text are those of its words in
    order. Ids are unsigned little-endian 32-bit numbers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
                size += len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        plain = pa.array([_plain_case(text).replace("\n", " ") for text in texts], pa.large_string())
        listed = pc.split_pattern(plain, " ")
        coded = pc.dictionary_encode(listed.flatten())
        codes = self._words(coded.dictionary.to_pylist())
        places = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        pool = np.frombuffer(b"".join(codes), "<u4")
        starts = np.cumsum(sizes) - sizes
        counts = sizes[places]
        ends = np.cumsum(counts)
        ids = pool[np.repeat(starts[places] - ends + counts, counts) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[listed.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        if len(self.known) > MEMO_WORDS:
            self.known = {}
        known = self.known
        found = list(map(known.get, words))
        new, i = [], -1
        for _ in range(found.count(None)):
            i = found.index(None, i + 1)
            new.append(i)
        letters = [i for i in new if words[i].isalpha() and words[i].islower()]
        others = [i for i in new if not (words[i].isalpha() and words[i].islower())]
        fresh = self._joined([words[i] for i in letters]) + self._apart([words[i] for i in others])
        for i, code in zip(letters + others, fresh, strict=True):
            found[i] = code
            if len(words[i]) <= MEMO_CHARS:
                known[words[i]] = code
        return found

    def _apart(self, words: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(words, add_special_tokens=False) if words else []
        return [np.array(code.ids, "<u4").tobytes() for code in codes]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, encoded as one text and cut after each word's last piece."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(ends) != len(words):
            return self._apart(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a vocabulary in this worker."""
    return worker_memo(f"tokens:{path}", lambda: WordEncoder(path))
