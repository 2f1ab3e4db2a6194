"""Ids of a word-level BPE vocabulary file (byte-level symbols, word-end suffix) for whole texts.

Texts of common Latin characters take a vectorised path: lower-casing, splitting and counting
equal words happen in Arrow and numpy, and each distinct word of a batch is merged once by the matrices of
``bpe``. Any other text goes to the tokenizers library, which is the definition of the result.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from landmatch.llm.bpe import Merges, merge_rows, ragged

#: The vocabulary file splits at these kinds: runs of letters, single numbers, runs of anything else.
SPACE, LETTER, DIGIT, OTHER = range(4)
#: The contractions 's 't 'm 'd and 're 've 'll.
TAILS = {1: [ord(c) for c in "stmd"], 2: np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")], np.uint64)}
KINDS = np.array([SPACE if c == 32 else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x180)], np.int8)
#: Characters for which Arrow and the library agree on case, classes and normal form.
PLAIN = "^[\t\n\r -~¡-įı-ž]*$"


def byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class WordVocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + end] for s in symbols], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a, b = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        merged = np.array([vocab[x + y] for x, y in pairs], np.int32)
        self.merges = Merges(a, b, np.arange(len(pairs), dtype=np.int32), merged)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct lower-case chunks without white space, one after another, and how many each has."""
        joined = " ".join([*words.to_pylist(), ""])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = KINDS[codes]
        begins = np.ones(len(kind), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        # a contraction is an apostrophe that opens a run, and the letters that follow
        quote = np.flatnonzero((codes[:-3] == ord("'")) & begins[:-3] & (kind[1:-2] == LETTER)) if len(codes) > 3 else np.empty(0, np.int64)
        after = np.array(TAILS[1])
        one = np.isin(codes[quote + 1], after)
        two = np.isin(codes[quote + 1].astype(np.uint64) << np.uint64(32) | codes[quote + 2], TAILS[2]) & ~one
        for at, n in ((quote[one], 2), (quote[two], 3)):
            begins[at + 1] = False
            begins[at + n] = True
        solid = kind != SPACE
        wide = np.where(codes < 0x80, 1, 2)
        starts = np.flatnonzero(begins & solid)
        lengths = np.add.reduceat(np.where(solid, wide, 0), starts) if len(starts) else np.empty(0, np.int64)
        counts = np.bincount(np.cumsum(~solid)[starts], minlength=len(words))
        data = np.frombuffer(joined.encode(), np.uint8)
        data = data[data != 32]
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
        flat = pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = flat.dictionary_encode()
        raw, code = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
        sizes = pc.binary_length(raw).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[data[last]]
        ids, n = merge_rows(symbols, sizes, self.merges)
        starts, of = np.cumsum(n) - n, n[code]
        ends = np.append(0, np.cumsum(of))[np.append(0, np.cumsum(counts))]
        return ids[ragged(starts[code], of)], np.diff(ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; a null text has none."""
        texts = pc.fill_null(texts, "")
        plain = pc.match_substring_regex(texts, PLAIN).to_numpy(zero_copy_only=False)
        lowered = pc.utf8_lower(texts.filter(pa.array(plain)))
        cut = pc.ascii_split_whitespace(lowered)
        sizes = pc.list_value_length(cut).to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        del cut, lowered
        ids, n = self.encode_words(coded.dictionary)
        code = coded.indices.to_numpy()
        starts, of = np.cumsum(n) - n, n[code]
        ends = np.append(0, np.cumsum(of))[np.append(0, np.cumsum(sizes))]
        flat, counts = ids[ragged(starts[code], of)], np.diff(ends)
        if plain.all():
            return flat, counts
        other = [np.array(e.ids, np.int32) for e in self.library.encode_batch(texts.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        total = np.zeros(len(plain), np.int64)
        total[plain], total[~plain] = counts, [len(x) for x in other]
        out = np.empty(int(total.sum()), np.int32)
        starts = np.cumsum(total) - total
        out[ragged(starts[plain], counts)] = flat
        out[ragged(starts[~plain], total[~plain])] = np.concatenate(other)
        return out, total


_LOADED: dict[str, WordVocabulary] = {}


def word_vocabulary(path: str) -> WordVocabulary:
    """One per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordVocabulary(path)
    return _LOADED[path]
